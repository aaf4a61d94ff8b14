"""Pure parts: min-cut, line classes, residue, encodings, profiles, packing plan, recompression."""

import itertools
import random
import re

import numpy as np
import pytest

from chronopanel.llm import encoding, hdlang, layout, leak, mincut, pack, pages, residue, spans
from chronopanel.llm import pagelines as pl


def energy(label, c0, c1, edges):
    return sum(c1[i] if x else c0[i] for i, x in enumerate(label)) + sum(w for i, j, w in edges if label[i] != label[j])


def test_minimum_cut_is_optimal():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        c0, c1 = [rng.uniform(0, 3) for _ in range(n)], [rng.uniform(0, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        best = min(energy(x, c0, c1, edges) for x in itertools.product((0, 1), repeat=n))
        assert energy(mincut.label(c0, c1, edges), c0, c1, edges) == pytest.approx(best)
    assert mincut.label([], [], []) == []


PAGE = """Startseite | Kontakt | Impressum
Sie sind hier: Presse > Neue Pressen
Neue Pressen
Unsere neuen Pressen arbeiten seit dem Frühjahr im Werk, weil die alten Maschinen zu langsam waren.

Artikel teilen
Typ | Gewicht kg | Leistung kW
AB-12 | 12,5 kg | 3,4 kW
Weitere Meldungen
12.03.2010 Neue Halle eröffnet »
Muster GmbH, Hauptstraße 12, 12345 Musterstadt
© 1999–2010 Muster GmbH"""


def test_page_body_is_kept_and_chrome_dropped():
    page = layout.split_page(PAGE, ("Neue Pressen | Muster GmbH",))
    body = [x.text for x, b in zip(page.lines, page.body, strict=True) if b]
    assert body == ["Neue Pressen", "Unsere neuen Pressen arbeiten seit dem Frühjahr im Werk, weil die alten Maschinen zu langsam waren.", "Typ | Gewicht kg | Leistung kW", "AB-12 | 12,5 kg | 3,4 kW"]
    assert page.body[4] is None and not page.notice_only


def test_repeated_sentence_is_chrome_and_damaged_menu_is_still_known():
    text = "HÃ¤ndlersuche\nWir liefern seit 1950 in alle Länder.\nDie Familie führt das Haus heute in der dritten Generation mit großer Sorgfalt."
    page = layout.split_page(text, (), {2: 3})
    assert page.body == [False, False, True]


@pytest.mark.parametrize("text", [None, "", "\n\n", " \t "])
def test_empty_pages(text):
    page = layout.split_page(text)
    assert not any(page.body) and not page.notice_only
    assert residue.find(page, text, None) == []


def test_very_long_lines_and_odd_characters():
    page = layout.split_page("x" * 300_000 + "\n" + "\ud800 \x00 ￿" + "\n" + "wort " * 60_000)
    assert len(page.lines) == 3


@pytest.mark.parametrize("slot", ["{{name}}", "${ort}", "<%= first_name %>", "<?php echo $Ihr Name; ?>", "[[author]]", "###jahr###", "@@ort@@", "%firma%", "[company_name]", "__ORT__", "{% title %}", "#{author}", "{$ort}", "&lt;jahr&gt;"])
def test_placeholders(slot):
    text = f"Wir sind seit Jahren in {slot} zu Hause und fertigen dort mit Sorgfalt."
    assert residue.find(layout.split_page(text), text, None)


@pytest.mark.parametrize("text", ["Die Platten tragen viel (Satz {A}, und).", "Neue Halle [mehr erfahren]", "Das gilt auch weiter (Teil [3], ost).", "Der Anteil stieg um 12 % auf 40 % im Jahr.", "var f=function(x){return p[12]||3;};if(x>5){f();}"])
def test_no_placeholders(text):
    assert not residue.slots(text)


def test_notices_filler_and_titles():
    notice = "Startseite | Kontakt | Impressum\nWegen Wartungsarbeiten ist unser Angebot vorübergehend nicht erreichbar."
    page = layout.split_page(notice)
    assert page.notice_only and page.body == [False, True]
    real = PAGE + "\nBitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite anzuzeigen."
    page = layout.split_page(real)
    assert not page.notice_only and page.body[-1] is False and not residue.find(page, real, None)
    assert residue.find(layout.split_page("Magnum incidi duisaut voluptas mollit pariat repreh occaec."), "x", None)
    assert residue.find(layout.split_page(PAGE), PAGE, "Unbenanntes Dokument")[0].kind == "title"


@pytest.mark.parametrize("channel", range(len(encoding.CHANNELS)))
def test_every_channel_is_undone(channel):
    true, read = encoding.CHANNELS[channel]
    word = "größere años à la carte"
    raw = word.encode("utf-8" if true == "twice" else true)
    table = encoding._CODE[read][1]
    bad = "".join(table[b] for b in raw)
    if true == "twice":
        bad = "".join(table[b] for b in bad.encode("utf-8"))
    assert bad != word and encoding.undo(bad, channel) == word


def test_clean_words_are_left_and_lost_letters_found():
    assert all(encoding.undo("São", k) is None for k, (t, _) in enumerate(encoding.CHANNELS) if t in ("utf-8", "twice"))
    assert encoding.best_path([("f",), ("ä", "ü", "é"), ("r",)], {"ü": -2.0, "ä": -2.1, "é": -3.0}) == "für"
    assert encoding.decide([]) == {}
    assert encoding.apply("a für b MÃ¼ c", {1: "Mü"}) == "a für b Mü c"


def test_profiles_tell_languages_apart():
    de, en = "der die das und nicht mit von auf für ist ein eine werden durch über ", "the of and to in is that with for was this have from they which would there "
    model = hdlang.train({k: np.bincount(hdlang.cells(t * 3), minlength=hdlang.CELLS).astype(float) for k, t in (("de", de), ("en", en))})
    assert model.nearest("wir werden durch das Dorf und über die Brücke") == "de" and model.nearest("they would have been there with this") == "en"
    assert model.nearest("12 34") is None
    texts = ["das ist nicht für die", "", "with that from the"]
    assert np.allclose(model.each(texts), np.stack([model.cosines(t) for t in texts]), atol=1e-4)


def test_bucket_choice_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(40):
        size = np.unique(rng.integers(1, 60, 11))
        n, most = rng.integers(1, 20, len(size)), int(rng.integers(1, 6))
        cost = lambda up: sum(c * (min(u for u in up if u >= s) - s) for s, c in zip(size, n, strict=True))  # noqa: B023, E731
        best = min(cost([*x, size[-1]]) for k in range(most) for x in itertools.combinations(size[:-1], k))
        assert cost(pack.optimal_buckets(size, n, most)) == best


def test_plan_places_every_item_once_within_capacity():
    rng = random.Random(5)
    for _ in range(100):
        sizes = sorted(rng.sample(range(1, 100), rng.randint(1, 8)))
        counts = [rng.randint(1, 40) for _ in sizes]
        kinds = pack.plan(sizes, counts, 100)
        assert [sum(k.count * k.items.get(b, 0) for k in kinds) for b in range(len(sizes))] == counts
        assert all(sum(sizes[b] * n for b, n in k.items.items()) <= 100 for k in kinds)


def test_recompression_names_equal_stretches_equally():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    for _ in range(60):
        shared = " ".join(word() for _ in range(120))[:500]
        a = " ".join(word() for _ in range(rng.randint(0, 200))) + shared + word()
        b = word() + shared + " ".join(word() for _ in range(rng.randint(0, 200)))
        key, of, _ = spans.anchors([a, b])
        assert set(key[of == 0]) & set(key[of == 1])
    assert len(spans.anchors([""])[0]) == 0 and len(spans.anchors([])[0]) == 0


def test_long_runs_meet_whatever_their_length():
    key, of, _ = spans.anchors(["ab " * 400, "x " + "ab " * 300])
    assert set(key[of == 0]) & set(key[of == 1])
    key, of, _ = spans.anchors(["-" * 700, "-" * 900])
    assert set(key[of == 0]) & set(key[of == 1])


def test_template_words():
    table = lambda *w: leak.Bits(8, np.packbits([any(leak._hash(x) >> 56 == k for x in w) for k in range(256)], bitorder="little"))
    v = leak.Vocabulary(table("altdorf", "pressen", "in"), table("altdorf"))
    assert [leak.symbol(w, v) for w in ("In", "ALTDORF", "25", "kg", "Pressen")] == ["in", leak.NAME, leak.NUMBER, leak.UNIT, "pressen"]
    assert leak.words(None) == [] and leak.words("e\u0301a_b") == ["éa", "b"]
    values = np.arange(1, 30, dtype=np.uint64)
    assert len(leak.window_hashes(values)) == 17 and len(set(leak.window_hashes(values).tolist())) == 17 and len(leak.window_hashes(values[:5])) == 0


def tokens_of(text):
    return [text[i:j] for i, j in encoding.spans(text)]


def test_quotes_made_by_a_wrong_decoding_stay_in_their_token():
    for true, bad in (("–", "â€“"), ("ideeën", "ideeÃ«n"), ("Ärger", "Ã„rger"), ("cœur", "cÅ“ur"), ("™", "â„¢"), ("Öl", "Ãƒâ€“l"), ("–", "вЂ“"), ("São", "S„o"), ("später", "sp„ter"), ("©î", "┬®├«")):
        assert tokens_of(f"a {bad} b") == [bad] and true in [x for _, x in encoding.readings(bad)]
    assert tokens_of("„Größe“ «État» „Spaß“ „Café“ CAFÉ“ »MENÜ« „a“") == ["Größe", "État»", "Spaß", "Café", "CAFÉ", "»MENÜ"]


def test_long_lines_are_judged_as_a_whole():
    prose = "Unsere neuen Pressen arbeiten seit dem Frühjahr im Werk, weil die alten Maschinen für die Kunden zu langsam waren. " * 4
    assert pl.classify(prose.strip()).kind == "prose"
    for mash in ("asdf jklo " * 10, "dolor consectetur adipiscing " * 6):
        assert pl.classify(f"{prose}{mash}{prose}".strip()).kind == "filler"
    assert pl.classify(prose + "§$ %& 12 34 §§ ## 56 " * 40 + "Ende.").kind == "junk"
    assert pl.classify(prose + "a1b x9y 7qz k3k zz4 " * 40 + "Ende.").kind == "junk"
    assert pl.classify("a1b x9y 7qz k3k zz4 " * 5 + prose.strip()).kind == "prose"


def test_mash_windows_equal_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        words = [rng.choice(("asdf", "Dolore", "jklm", "xx", "Werk", "die", "Dolor")) if rng.random() < 0.8 else "der" for _ in range(rng.randint(0, 40))]
        brute = any(pl.is_lorem(words[i : i + pl.WINDOW]) for i in range(max(1, len(words) - pl.WINDOW + 1)))
        assert pl.has_lorem(words, [w.lower() for w in words]) == brute


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        ("cookie", "Diese Website verwendet Cookies, um Ihnen den bestmöglichen Besuch zu bieten. Mit der weiteren Nutzung unserer Seiten stimmen Sie der Speicherung von Cookies zu."),
        ("script", "Bitte aktivieren Sie JavaScript in den Einstellungen Ihres Browsers, damit Sie alle Funktionen unseres Angebots in vollem Umfang und ohne Fehler nutzen können."),
        ("notice", "The page you requested does not exist any more, or it has been moved to another address by the owner of this site. Please use our search to find it again."),
        ("footer", "© 2001–2014 Muster Maschinen und Anlagen GmbH & Co. KG. All rights reserved, also for extracts, pictures and translations of any kind that are taken from these pages."),
        ("site", "All rights reserved, also for extracts, pictures and translations. All prices plus VAT, as stated in our general terms of sale that you find on the page on orders."),
    ],
)
def test_long_furniture_is_known(kind, text):
    assert len(text) > 150 and pl.classify(text).kind == kind


def test_prose_that_mentions_furniture_stays_prose():
    text = "Die neue Anlage läuft seit Mai im Werk. Die Leitung hat sie selbst geplant und mit den Kunden lange besprochen. Seit Juni verwendet Cookies nur noch, wer sie für die Bestellung braucht. Alle anderen Dienste kommen ohne sie aus."
    assert pl.classify(text).kind == "prose"


def test_the_cut_overrules_weak_lines():
    text = "Unsere Pressen laufen seit Jahren ohne Störung im alten Werk.\nNeue Wege\nDie Halle wurde im Mai gebaut und im Juni von der Familie eröffnet."
    costs = layout.prior()._replace(place=np.array([0, 0, 0, 0, 0, 0.0]), kind=np.where(np.array(layout.KINDS) == "head", 1.0, layout.KIND_VOTES))
    lines = lambda c: layout.split_page(text, (), None, c).body
    assert lines(costs._replace(edges=np.zeros(3))) == [True, False, True] and lines(costs) == [True, True, True]


def test_fitted_costs_follow_the_votes_and_learn_places():
    rng = np.random.default_rng(1)
    n, per = 4000, 8
    of, no = np.repeat(np.arange(n // per), per), np.tile(np.arange(per), n // per)
    top = (no == 0) | (no == per - 1)
    kind = np.where(top, layout.CODE["menu"], layout.CODE["prose"])
    lost = top & (rng.random(n) < 0.2)
    kind[lost] = layout.CODE["head"]
    x = layout.describe(of, no, kind, np.full(n, 9), np.full(n, 1), np.zeros(n, bool), np.where(top & ~lost, 3, 0))
    costs = layout.fit(*layout.tally(x))
    assert costs.place[0] > 2 and costs.place[2] < 0 and abs(costs.kind[layout.CODE["menu"]] - layout.KIND_VOTES[layout.CODE["menu"]]) <= layout.SWING
    assert (layout.cut(x, costs) == top).mean() > 0.99
    assert layout.fit(np.zeros(int(np.prod(layout.SHAPE))), np.zeros(12)).edges.tolist() == layout.prior().edges.tolist()


def test_cut_equals_the_whole_minimum():
    rng = np.random.default_rng(4)
    n = 300
    of = np.sort(rng.integers(0, 60, n))
    of = np.unique(of, return_inverse=True)[1]
    no = np.arange(n)
    x = layout.describe(of, no, rng.integers(1, len(pl.KINDS), n), rng.integers(1, 20, n), rng.integers(0, 3, n), rng.random(n) < 0.1, rng.integers(0, 4, n))
    costs = layout.Costs(rng.normal(0, 2, len(layout.KINDS)), rng.normal(0, 1, 24), rng.normal(0, 1, 6), rng.normal(0, 1, 2), np.array([2.5, 0.9, 0.2]))
    odds, got = layout.unary(x, costs), layout.cut(x, costs)
    for p in range(int(of[-1]) + 1):
        at = np.flatnonzero(of == p)
        edges = [(k - 1, k, float(costs.edges[x.edge[i]])) for k, i in enumerate(at) if k]
        c0, c1 = np.maximum(odds[at], 0).tolist(), np.maximum(-odds[at], 0).tolist()
        best = energy(mincut.label(c0, c1, edges), c0, c1, edges)
        assert energy(got[at].astype(int).tolist(), c0, c1, edges) == pytest.approx(best)


def test_line_sums_equal_counting():
    texts = ["Ein Satz, gut.", "", "ABC 12 %%", "ärger"]
    got = pages.line_sums(texts, [3, 0, 3, 1], [1, 0, 0, 0])
    for t, r in zip(texts, got.tolist(), strict=True):
        w = t.split(" ") if t else []
        assert r[1:6] == [sum(map(str.isalpha, t)), sum(map(str.isdigit, t)), sum(not c.isalnum() and c != " " for c in t), sum(map(str.isupper, t)), t.count(",")] and r[9] == sum(len(x) ** 2 for x in w)


def test_letters_of_other_scripts_are_near_no_language():
    de = "der die das und nicht mit von auf für ist ein eine werden durch über "
    model = hdlang.train({k: np.bincount(hdlang.cells(t * 3), minlength=hdlang.CELLS).astype(float) for k, t in (("de", de), ("en", "the of and to in is that with for was this have "))})
    assert abs(model.each(["Наша компания производит станки и детали для всех заводов страны"])[0]).max() < 0.07 < model.each([de])[0].max()


def test_tokens_equal_their_pattern():
    rng = random.Random(6)
    signs = "aZ9 .,(äÃ«„“»Å“â€™¬–\ufffd\nÐ\U0001f600"
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        assert tokens_of(text) == [m.group() for m in re.finditer(encoding.TOKEN, text)]


@pytest.mark.parametrize(("bad", "true"), [("â€\ufffd", "”"), ("Ã\ufffdda", "Ída"), ("KÃ¶nigâ€\ufffd", "König”"), ("â\ufffd\ufffd", "–")])
def test_lost_bytes_are_wildcards_of_the_channel(bad, true):
    letter = {"”": -3.0, "Í": -6.0, "Á": -6.5, "ö": -2.0, "–": -2.5}
    assert true in [encoding.best_path(x.columns, letter) for x in encoding.patterns(bad) if x.columns]
    assert any(x.columns and encoding._inside(bad, x.channel, true) for x in encoding.patterns(bad))


def test_no_lattice_for_what_no_channel_made():
    assert [x.channel for x in encoding.patterns("f\ufffdr")] == [encoding.LOST_BYTES] and [x.channel for x in encoding.patterns("\ufffd")] == [encoding.LOST_BYTES]


def test_stretches_inside_texts_without_gaps_meet():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    for _ in range(40):
        shared = word(600)
        key, of, _ = spans.anchors([word(rng.randint(0, 300)) + shared + word(50), word(rng.randint(0, 300)) + shared])
        assert set(key[of == 0]) & set(key[of == 1])


def test_kept_names_are_the_least_of_their_neighbours():
    rng = random.Random(3)
    for _ in range(50):
        of = sorted(rng.randint(0, 3) for _ in range(rng.randint(1, 20)))
        key = [rng.randint(0, 30) for _ in of]
        want = set()
        for t in set(of):
            at = [i for i, x in enumerate(of) if x == t]
            for i in range(max(1, len(at) - spans.NEIGHBOURS + 1)):
                w = at[i : i + spans.NEIGHBOURS]
                want |= {k for k in w if key[k] == min(key[j] for j in w)}
        assert set(spans._least(np.array(key, dtype=np.uint64), np.array(of)).tolist()) == want

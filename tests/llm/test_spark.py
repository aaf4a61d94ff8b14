"""The operators on small tables: known cases, brute force, and nulls, empty tables, repeated rows, ties and columns with clashing names."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from chronopanel.llm import bodies, encoding, hdlang, language, leak, lines, pack, pages, quality, queries, residue, spans

PAGES = "firm_id string, relative_timepoint string, original_archived_url string, registrable_domain string, document_title string, h1_text string, meta_description string, extracted_text string, text_language string, html_lang string, pid int, n string, line string"
WORDS = {"de": "der die das und nicht mit von auf für ist ein eine werden durch über wir haben unsere".split(), "en": "the of and to in is that with for was this have from they which our are".split()}
DE = "Wir haben unsere Maschinen für das Werk in der Stadt gebaut, und die Kunden sind mit der Arbeit von uns zufrieden."
EN = "We have built the machines for this town with our own hands, and they are used in many of the works that we know."


def page(i, text, domain="a.de", title=None, lang="de"):
    return ("1", "event", f"http://{domain}/{i}", domain, title, None, None, text, lang, lang, 1, "n", "x")


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(k, w, i) for k, v in WORDS.items() for i, w in enumerate(v)], "lang string, word string, word_rank int")


def table(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def labels(t, words):
    return pages.prepared(t, language.profiles(t, words), words, marks=True, languages=True)


EDGE = [page("e1", None), page("e2", ""), page("e3", " \n\t"), (None,) * 10 + (None, None, None), page("e4", "ein", None), page("e5", "wort " * 30_000), page("e6", "x" * 100_000)]


def test_page_operators_take_edge_cases(spark, words):
    for rows in ([], EDGE):
        t = table(spark, rows)
        own = labels(t, words)
        assert encoding.found(t).count() == 0 and lines.found(t).count() == 0
        encoding.restored(t).count(), lines.cleaned(t).count(), language.found(own).count(), language.segments(own).count(), quality.found(quality.assessed(own)).count(), bodies.bodies(t, own).count(), residue.pieces(own).count()


def test_encoding_is_found_and_restored(spark):
    clean = [page(i, "Für größere Maschinen gelten die Übergänge.\nDas ist später gut.") for i in range(30)]
    t = table(spark, clean + [page("x", "FÃ¼r größere Maschinen\nDas ist spÃ¤ter gut."), page("x", "FÃ¼r größere Maschinen\nDas ist spÃ¤ter gut."), page("y", "São Paulo ± 3 °C"), page("z", "sp�ter", title="Größe")])
    got = {r["original_archived_url"]: r["restored"] for r in encoding.restored(t).collect()}
    assert got == {"http://a.de/x": "Für größere Maschinen\nDas ist später gut.", "http://a.de/z": "später"}
    assert encoding.found(t).count() == 2


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [page(i, "\n".join(rng.choice(["a", "b ", "c", "", "d  e", "d\te", f"u{i}"]) for _ in range(rng.randint(1, 9))), rng.choice(["a.de", "b.de"])) for i in range(60)]
    rows += rows[:10]
    seen = {}
    for r in rows:
        for x in r[7].split("\n"):
            x = " ".join(x.replace("\t", " ").split())
            if x:
                seen.setdefault((r[3], x), set()).add(r[2])
    assert {tuple(r) for r in lines.found(table(spark, rows)).collect()} == {k for k, v in seen.items() if len(v) >= 8}
    kept = {r["original_archived_url"]: r["text"] for r in lines.cleaned(table(spark, rows)).collect()}
    assert all("a" not in t.split("\n") for t in kept.values())


@pytest.mark.parametrize("pieces", [1, 5, 40])
def test_blocks_equal_brute_force(spark, pieces):
    rng = random.Random(8)
    docs = [[[rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 2))] for _ in range(50)]
    rows = [(src, i, i, [(0, 10 * r + k, x) for r, run in enumerate(d) for k, x in enumerate(run)]) for src in (1, 2) for i, d in enumerate(docs) if src == 1 or i % 2]
    runs = spark.createDataFrame(rows, "s long, a long, b long, seq array<struct<u: long, k: int, id: long>>")
    weighted = lines.weighted(runs)
    array = weighted.repartitionByRange(pieces, "s", "ids").sortWithinPartitions("s", "ids").mapInPandas(lines._scan(8), "s long, block array<long>, n long")
    got = {(r["s"], tuple(r["block"])): r["n"] for r in array.groupBy("s", "block").agg(F.sum("n").alias("n")).where("n >= 8").collect()}
    count = {}
    for s, i, _, _ in rows:
        for b in {tuple(run[x:y]) for run in docs[i] for x in range(len(run)) for y in range(x + 1, len(run) + 1)}:
            count[s, b] = count.get((s, b), 0) + 1
    assert got and all(count[b] == n for b, n in got.items()) and {b for b in count if len(b[1]) == 1 and count[b] >= 8} <= set(got)
    longer = lambda b: max((count.get((b[0], (*b[1], x)), 0) for x in (1, 2, 3)), default=0)
    assert {b for b, n in count.items() if n >= 8 and longer(b) < n} <= set(got)
    if pieces == 5:
        assert {(r["s"], tuple(r["block"])): r["docs"] for r in lines.blocks(weighted).collect()}.items() >= {b: n for b, n in count.items() if n >= 8 and longer(b) < n}.items()


def test_long_runs_give_linear_suffixes():
    run = list(range(1, 3001))
    got = lines.suffixes([[run]] * 9)
    assert len(got) == 3000 and max(map(len, got)) == lines.LONGEST and set(got.values()) == {9}
    assert lines.suffixes([[[1, 1, 1]]]) == {(1, 1, 1): 1} and lines.suffixes([]) == {}


def test_a_line_twice_on_one_page_counts_once(spark):
    rows = [page(i, "a\na\nb\na") for i in range(7)]
    assert lines.found(table(spark, rows)).count() == 0
    rows.append(page(7, "x\n\ta "))
    assert {tuple(r) for r in lines.found(table(spark, rows)).collect()} == {("a.de", "a")}
    got = {r["original_archived_url"]: (r["text"], r["removed_lines"]) for r in lines.cleaned(table(spark, [*rows, page(8, "a", None)])).collect()}
    assert got["http://a.de/0"] == ("b", 3) and got["http://a.de/7"] == ("x", 1) and got["http://None/8"] == ("a", 0)


def test_languages(spark, words):
    rows = [page(i, "\n".join([DE] * 3), lang="de") for i in range(6)] + [page(f"en{i}", "\n".join([EN] * 3), "b.de", lang="en") for i in range(6)]
    rows += [page("w", f"{EN}\n{EN} Yes.", "c.de", lang="de"), page("m", f"{DE} Ja.\n{EN} No.", "d.de", lang="de"), page("n", f"{DE} Gut.", "e.de", lang=None), page("r", f"{DE} Fein.", "f.de", lang="DE_at")]
    t = table(spark, rows)
    assert {(r[2][-1], r[3]) for r in language.found(labels(t, words)).collect()} == {("w", "en"), ("m", "de"), ("m", "en"), ("n", "de")}


def test_passages(spark):
    passage = "From Altdorf exactly 581 crates with these unusual packages reached the Muster family in 1921 by train."
    e = spark.createDataFrame([(1, passage), (2, "too short"), (3, None), (1, passage)], "eval_id long, passage string")
    d = [(1, "Well: " + passage.upper().replace(" ", "  ")), (2, passage[:60]), (3, unicodedata.normalize("NFD", passage)), (4, passage.replace("581", "99").replace("Altdorf", "Neudorf").replace("1921", "1950")), (5, None), (None, passage), (6, "")]
    docs = spark.createDataFrame([(*x, "clash") for x in d], "doc_id long, text string, passage string")
    assert {tuple(r) for r in leak.found(docs, e).where("doc_id is not null").collect()} == {(1, 1), (1, 3)}
    got = {r["doc_id"]: r for r in leak.report(docs, e).collect() if r["doc_id"] is not None}
    assert set(got) == {1, 3, 4} and (got[4]["exact_windows"], got[4]["changed_fillers"]) == (0, 3) and got[4]["changed_windows"] == got[1]["exact_windows"] > 0
    twisted = docs.limit(0).union(spark.createDataFrame([(8, d[3][1].replace("1950", "99"), "x")], docs.schema))
    assert leak.report(twisted, e).where("changed_windows > 0").count() == 0
    assert leak.found(docs.limit(0), e).count() == 0 and leak.found(docs, e.limit(0)).count() == 0


def test_shared_spans(spark):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))) for _ in range(n))
    s500, s499 = text(200)[:500], text(200)[:499]
    rows = [(1, text(50) + "Q" + s500 + "Q"), (2, "Z" + s500 + "Z" + text(90)), (3, "X" + s499 + "X" + text(40)), (4, text(40) + "Y" + s499 + "Y"), (5, text(100)), (7, None), (None, "x"), (8, "-" * 900), (9, "a" + "-" * 600)]
    rows.append((6, rows[4][1]))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, a int")
    assert {tuple(r) for r in spans.found(docs).collect()} == {(1, 2), (5, 6), (8, 9)}
    got = {r["doc_id"]: r for r in spans.coverage(docs).collect()}
    assert (got[1]["shared_chars"], got[1]["links"], got[3]["shared_chars"], got[6]["class_id"]) == (500, 1, 0, 5)
    assert got[6]["shared_chars"] == len(rows[4][1]) and spans.found(docs.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(2)
    sizes = [(i, "t", rng.randint(0, 250)) for i in range(400)] + [(1000, "t", 1234), (1001, "t", 0)]
    counts = spark.createDataFrame(sizes, "doc_id long, tokenizer_name string, tokens long")
    targets = spark.createDataFrame([(1, "t", 100), (2, "t", 0), (3, None, 9), (1, "t", 100)], "target_id int, tokenizer_name string, capacity_tokens int")
    rows = pack.containers(counts, targets).collect()
    room, whole = {}, {}
    for r in rows:
        room[r["container_id"]] = room.get(r["container_id"], 0) + r["tokens"]
        whole.setdefault(r["doc_id"], []).append((r["first_token"], r["tokens"]))
    assert max(room.values()) <= 100 and {d: sum(n for _, n in v) for d, v in whole.items()} == {i: n for i, _, n in sizes if n}
    assert all(len(v) == -(-sum(n for _, n in v) // 100) for v in whole.values())
    assert sum(room.values()) / (100 * len(room)) > 0.9 and pack.containers(counts.limit(0), targets).count() == 0
    with pytest.raises(ValueError):
        pack.token_counts(spark.createDataFrame([(1, "x")], "doc_id long, text string"), ["unknown"])


def test_statistics_contributions_add_up(spark, words):
    rows = [page(i, f"{DE} {i}\n{DE}\n{DE}", f"{i}.de") for i in range(50)] + [page("l", "\n".join(f"- Platte AB-{i}" for i in range(30))), page("c", "Kontakt | Impressum | Presse")]
    t = table(spark, rows)
    a = quality.assessed(labels(t, words))
    assert {r[2][-1] for r in quality.found(a).collect()} == {"l", "c"}
    assert all(abs(sum(r["contributions"]) - r["distance"]) < 1e-6 for r in a.where(F.col("distance").isNotNull()).collect())
    assert len(quality.STATISTICS) == 10 and isinstance(hdlang.CELLS, int) and pages.KEY[0] == "firm_id"


def test_damage_that_ends_in_a_quote_is_found_alone(spark):
    clean = [page(i, "De ideeën – Ärger und später.") for i in range(30)]
    t = table(spark, [*clean, page("n", "x", title="Unternehmen â€“ Papier"), page("e", "De ideeÃ«n"), page("u", "Ã„rger heute"), page("q", "„Ärger“ « später »")])
    assert {r["original_archived_url"][-1]: r["restored"] for r in encoding.restored(t).collect()} == {"n": "Unternehmen – Papier", "e": "De ideeën", "u": "Ärger heute"}


def test_lost_bytes_take_any_corpus_word_and_stay_where_none_is_known(spark):
    clean = [page(i, "reçu revêtements größere ideeën Übermaß – für «Öl»\n" + "für über ähnlich später " * 20) for i in range(20)]
    bad = {"a": ("re�u", "reçu"), "b": ("rev��tements", "revêtements"), "c": ("gr��ere", "größere"), "d": ("�berma�", "Übermaß"), "e": ("idee�n", "ideeën"), "f": ("xy�zzy", "xy�zzy"), "g": ("a ��� b", "a – b"), "h": ("�The", "�The")}
    t = table(spark, clean + [page("ok", "ôThe")] + [page(k, x) for k, (x, _) in bad.items()])
    assert {r["original_archived_url"][-1]: r["restored"] for r in encoding.restored(t).collect()} == {k: y for k, (_, y) in bad.items()}
    assert encoding.found(t).count() == len(bad)


def test_token_of_many_lost_bytes_is_a_case(spark):
    assert encoding.patterns("�a" * 8)[0] == (encoding.LOST_BYTES, "�a" * 8, None)
    t = table(spark, [page(i, "Für Maschinen") for i in range(9)] + [page("w", "�a" * 8), page("r", "�" * 40)])
    assert {r["original_archived_url"][-1]: r["restored"] for r in encoding.restored(t).collect()} == {"w": "�a" * 8, "r": "�" * 40}


def test_every_page_with_text_has_a_language(spark, words):
    rows = [page(i, "\n".join([DE] * 3)) for i in range(6)] + [page(f"en{i}", "\n".join([EN] * 3), "b.de", lang="en") for i in range(6)]
    rows += [page("ru", "Наша компания производит станки и детали для всех заводов страны.", lang="ru"), page("m", "Kontakt | Impressum"), page("n", "12 34"), page("h", "Maschinen für das Werk")]
    got = {}
    for r in language.segments(labels(table(spark, rows), words)).collect():
        got.setdefault(r[2].rsplit("/", 1)[1], set()).add(r["lang"])
    assert len(got) == len(rows) and got["ru"] == {"und"} and got["n"] == {"und"} and got["0"] == {"de"} and got["h"] == {"de"}
    assert "ru" not in {r[3] for r in language.found(labels(table(spark, rows), words)).collect()}


def test_bodies_and_shared_labels(spark, words):
    text = "Startseite | Kontakt | Impressum\nDie neue Halle wurde im Mai mit der Familie und allen Kunden eröffnet.\n\n© 1999–2010 Muster GmbH"
    t = table(spark, [page("a", text), page("a", text), page("b", "© 1999–2010 Muster GmbH"), page("c", None)])
    own = labels(t, words)
    assert {(r[2][-1], r["body"], r["boilerplate_ratio"]) for r in bodies.bodies(t, own).collect()} == {("a", text.split("\n")[1], round(1 - len(text.split("\n")[1]) / len(text), 3)), ("b", "", 1.0)}
    assert {(r[2][-1], r["line_no"]) for r in bodies.found(own).collect()} == {("a", 1), ("a", 4), ("b", 1)}


def test_titles_without_text_are_read_for_residue(spark, tmp_path):
    table(spark, [page("t", None, title="{{ title }}"), page("u", " \n", title="Untitled Document"), page("v", None, title="Presse"), page("w", "x", title=" "), *EDGE[:4]]).write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["original_archived_url"][-1] for r in queries.p2_found(spark, str(tmp_path)).collect()} == {"t", "u"}


def test_lost_bytes_inside_damage_and_lone_dashes(spark):
    clean = [page(i, "Die Halle – „Ída“ und ”König” für später.\n" + "für – “Quote” später " * 30) for i in range(20)]
    bad = {"a": ("â€œQuoteâ€\ufffd", "“Quote”"), "b": ("Ã\ufffdda", "Ída"), "c": ("Halle Ð König", "Halle – König"), "d": ("seit 1934 û Werk", "seit 1934 – Werk")}
    t = table(spark, clean + [page("ok", "«État» où CHÂTEAU")] + [page(k, x) for k, (x, _) in bad.items()])
    assert {r["original_archived_url"][-1]: r["restored"] for r in encoding.restored(t).collect()} == {k: y for k, (_, y) in bad.items()}


def test_shared_spans_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 3)
    rng = random.Random(21)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passages = [text(140)[:640], text(200)[:900], "abcde " * 130, text(100)[:499]]
    rows = []
    for i in range(26):
        parts = [text(rng.randint(0, 60))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            cut = rng.choice([0, 0, 120])
            parts += [p[cut:], text(rng.randint(1, 30))]
        rows.append((i, "|".join(parts)))
    rows.append((90, rows[3][1]))
    pieces = {i: {t[k : k + 500] for k in range(len(t) - 499)} for i, t in rows}
    want = {(a, b) for a in pieces for b in pieces if a < b and pieces[a] & pieces[b]}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in spans.found(docs).collect()} == want and len(want) > 20
    cover = {}
    for a, t in rows:
        other = set().union(*(pieces[b] for b in pieces if b != a))
        seen = [False] * len(t)
        for k in range(len(t) - 499):
            if t[k : k + 500] in other:
                seen[k : k + 500] = [True] * 500
        cover[a] = sum(seen)
    assert {r["doc_id"]: r["shared_chars"] for r in spans.coverage(docs).collect()} == cover


def test_ranks_in_parts(spark):
    items = spark.createDataFrame([(i, 0, 5, i % 3) for i in range(100)], "doc_id long, first_token long, size long, bucket int")
    got = {}
    for r in pack._ranks(items, [34, 33, 33], 7).collect():
        got.setdefault(r["bucket"], []).append(r["rank"])
    assert {b: sorted(x) for b, x in got.items()} == {0: list(range(34)), 1: list(range(33)), 2: list(range(33))}


def test_page_operators_without_common_words_and_with_clashing_columns(spark, words):
    t = table(spark, [page(i, f"{DE}\n{EN}") for i in range(3)] + EDGE)
    for c in ("a", "b", "u", "d", "h", "kind", "own", "size", "repeats", "chrome", "lang", "stats", "sums", "text", "token", "s", "ids", "at", "_p"):
        t = t.withColumn(c, F.lit("clash"))
    for w in (words, words.limit(0)):
        own = labels(t, w)
        assert own.count() == 6 and quality.assessed(own).count() == 6 and language.segments(own).where("lang is null").count() == 0
    assert language.segments(own).count() == 0 and language.found(own).count() == 0
    assert lines.cleaned(t).count() == 6 and encoding.restored(t).count() == 0 and bodies.bodies(t, own).count() == 6


def test_standing_sentences_are_chrome_and_reused_ones_body(spark, words):
    own = lambda i: f"Die Halle Nummer {i} wurde im Mai mit der Familie und allen Kunden eröffnet und danach bezogen."
    standing, reused = "Seit drei Generationen steht unser Haus für gute Maschinen aus der Stadt.", "Das Werk liefert alle Pressen in viele Länder der Welt und baut sie auch um."
    rows = [page(i, "\n".join([own(i), *([standing] if i % 3 == 0 else []), *([reused] if i in (4, 5) else []), own(i + 500)])) for i in range(60)]
    got = {(r[2].rsplit("/", 1)[1], r["line_no"]) for r in bodies.found(labels(table(spark, rows), words)).collect()}
    assert got == {(str(i), 2) for i in range(0, 60, 3)}

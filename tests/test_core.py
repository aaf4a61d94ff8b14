"""Core operators: fixed expectations, brute-force models, one end-to-end run on a small site."""

import datetime as dt
import random
import warnings

import pytest
from pyspark.sql import functions as F

from chronopanel import schemas
from chronopanel.config import Config, Crawl, Quality, Selection
from chronopanel.functions import html, urls
from chronopanel.functions import text as tx
from chronopanel.operators import asof, captures, crawl, grid, quality, tables
from chronopanel.plans import pipeline

CAPTURE = "firm_id string, seed_ord int, row_ord int, urlkey string, timestamp string, original string, mimetype string, statuscode string, digest string, length string, redirect string"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def rows(spark, *stamps):
    return spark.createDataFrame([("1", 0, i, "k", t, f"http://a.de/{i}", "text/html", "200", None, None, None) for i, t in enumerate(stamps)], CAPTURE)


def observed(spark, target, future=False):
    return spark.createDataFrame([("1", "event", target, future)], "firm_id string, relative_timepoint string, target_date date, observation_is_future boolean")


def test_grid_has_five_timepoints(spark):
    firms = spark.createDataFrame([("1", 1, 2015), ("2", 2, None)], "firm_id string, rank int, event_year int")
    got = grid.observations(firms, Config()).where("firm_id = '1'").orderBy("target_year").collect()
    assert [r["target_year"] for r in got] == [2011, 2013, 2015, 2017, 2019] and got[2]["target_date"] == dt.date(2015, 7, 1)
    assert grid.observations(firms, Config()).where("firm_id = '2' and target_date is null").count() == 5


@pytest.mark.parametrize(
    ("stamps", "target", "future", "status", "stamp", "days"),
    [
        ((), dt.date(2030, 7, 1), True, "future_unavailable", None, None),
        ((), dt.date(2015, 7, 1), False, "not_found", None, None),
        (("20150615120000", "20140101000000"), dt.date(2015, 7, 1), False, "selected", "20150615120000", 16),
        (("20100101000000",), dt.date(2015, 7, 1), False, "beyond_tolerance", None, None),
        (("20150621000000", "20150711000000"), dt.date(2015, 7, 1), False, "selected", "20150711000000", 10),
        (("", "2015070", None, "20159901000000"), dt.date(2015, 7, 1), False, "beyond_tolerance", None, None),
    ],
)
def test_selection(spark, stamps, target, future, status, stamp, days):
    got = asof.select_captures(observed(spark, target, future), rows(spark, *stamps), Selection()).first()
    assert (got["snapshot_status"], got["archive_timestamp"], got["temporal_distance_days"]) == (status, stamp, days)


def test_tie_break_and_first_row(spark):
    both = rows(spark, "20150621000000", "20150711000000")
    assert asof.select_captures(observed(spark, dt.date(2015, 7, 1)), both, Selection(tie_break="earlier")).first()["archive_timestamp"] == "20150621000000"
    same = rows(spark, "20150615120000", "20150615080000")
    assert asof.select_captures(observed(spark, dt.date(2015, 7, 1)), same, Selection()).first()["canonical_original_url"] == "http://a.de/0"


def test_captures(spark):
    lines = spark.createDataFrame([('["urlkey","timestamp","original","mimetype","statuscode","digest","length","redirect"]',), ('["k","20150615120000","http://a.de/"]',), ("no json",)], "value string")
    got = captures.from_json_rows(lines).collect()
    assert len(got) == 1 and got[0]["original"] == "http://a.de/" and got[0]["digest"] == ""
    twice = spark.createDataFrame([("1", 1, 0, "k", "t", "u", "m", "200", "late", None, None), ("1", 0, 5, "k", "t", "u", "m", "200", "first", None, None)], CAPTURE)
    assert [r["digest"] for r in captures.dedupe(twice).collect()] == ["first"]
    run = spark.createDataFrame([("1", 0, i, "k", str(i), "u", "m", "200", d, None, None) for i, d in enumerate(["a", "a", None, None, "b", "a"])], CAPTURE)
    assert [r["row_ord"] for r in captures.collapse(run, ["firm_id"], ["timestamp"]).orderBy("row_ord").collect()] == [0, 2, 4, 5]


@pytest.mark.parametrize(
    ("function", "url", "want"),
    [
        (urls.unwrap, "https://web.archive.org/web/20150301000000id_/http://www.example.com/about", "http://www.example.com/about"),
        (urls.normalize_original, "https://www.Example.com/path/", "https://www.example.com/path"),
        (urls.normalize, "https://www.example.com/page#section", "https://www.example.com/page"),
        (urls.normalize, "HTTP://A.de//", "http://a.de"),
        (urls.is_excluded, "https://www.example.com/logo.png", True), (urls.is_excluded, "mailto:a@b.de", True), (urls.is_excluded, "https://a.de/tag/x", True), (urls.is_excluded, "https://a.de/tag", False),
        (urls.registrable_domain, "https://www.example.co.uk/about", "example.co.uk"), (urls.subdomain, "https://www.example.co.uk/about", "www"), (urls.suffix, "https://localhost/", ""),
        (urls.is_archive_url, "https://web.archive.org./web/1/x", True), (urls.is_archive_url, "https://a.de/", False),
    ],
)
def test_urls(spark, function, url, want):
    assert one(spark, function(F.col("u")), u=url) == want


def test_more_urls(spark):
    assert one(spark, urls.build_replay_url(F.col("u"), F.col("t")), u="www.example.com/ü b*", t="20150301000000") == "https://web.archive.org/web/20150301000000id_/https://www.example.com/%C3%BC%20b%2A"
    assert one(spark, urls.normalize(F.col("u"), False, ["utm_"]), u="https://a.de/x/?a=1&utm_s=9&b=2&a=3") == "https://a.de/x?a=1&a=3&b=2"
    score = lambda u: one(spark, urls.branding_score(F.col("u"), {"de": ["ueber-uns", "geschichte"], "en": ["about"]}, True), u=u)
    assert (score("https://a.de/ueber-uns"), score("https://a.de/about")) == (130, 74)


def test_text(spark):
    assert one(spark, tx.word_count(F.col("t")), t="  a b\n c ") == 3 and one(spark, tx.word_count(F.col("t")), t=None) == 0
    got = one(spark, tx.strip_noise(F.col("t")), t="eins\nReplay Toolbar\r\nzwei")
    assert (got["text"], got["removed"]) == ("eins\nzwei", True)
    menu = " ".join(["Home", "Kontakt,", "Impressum", "Login", "Privacy", "Contact"] + ["wort"] * 30)
    assert one(spark, tx.menu_only(F.col("t")), t=menu) and not one(spark, tx.menu_only(F.col("t")), t="wort " * 30) and one(spark, tx.menu_only(F.col("t")), t=None)
    assert one(spark, tx.soft_404(F.col("t"), F.col("h")), t="x" * 299, h="Error 404") and not one(spark, tx.soft_404(F.col("t"), F.col("h")), t="x" * 300, h="Error 404")


HTML = b"""<html lang="de"><head><title> Titel </title><meta name="description" content="D"><meta property="og:title" content="O"><link rel="canonical" href="/c"></head>
<body><nav><a href="/ueber-uns">U</a><a href="#x">x</a></nav><h2>Zwei</h2><h1>Eins</h1><p>Text eins.</p><script>no()</script><a href="https://b.de/y">y</a><a href="/web/20150301000000/http://a.de/z">z</a></body></html>"""


def test_html(spark):
    m = html.metadata_of(HTML)
    assert (m["document_title"], m["html_lang"], m["meta_description"], m["og_title"], m["canonical_url"], m["h1_text"]) == ("Titel", "de", "D", "O", "/c", "Eins")
    assert [h["level"] for h in m["headings"]] == [1, 2] and html.metadata_of(None)["document_title"] is None
    assert html.text_of(HTML)["extracted_text"] == "Zwei\nEins\nText eins.\nyz" and html.text_of(b"")["extracted_text"] is None
    got = html.links(spark.createDataFrame([("s", bytearray(HTML), "http://a.de/"), ("t", None, None)], "k string, content binary, url string"), ["k"]).orderBy("pos").collect()
    assert [r["link"] for r in got] == ["http://a.de/ueber-uns", "https://b.de/y", "http://a.de/z"]


PAGE = "extracted_text string, character_count int, fetch_error string, http_status int, registrable_domain string, temporal_distance_days int, document_title string, archive_toolbar_removed_flag boolean, final_url string"


@pytest.mark.parametrize(
    ("page", "usable", "reason"),
    [
        (("wort " * 40, 200, None, 200, "a.de", 1, None, None, None), True, None),
        (("wort " * 40, 200, "timeout", 500, "b.de", 1, None, None, None), False, "timeout"),
        (("wort " * 40, 200, None, 500, "b.de", 1, None, None, None), False, "http_500"),
        (("wort " * 40, 200, "", 200, "b.de", 1, None, None, None), False, "wrong_registrable_domain"),
        ((None, None, None, None, None, None, None, None, None), False, "empty_text"),
        (("not found", 9, None, 200, "a.de", 1, None, None, None), False, "soft_404"),
        (("wort " * 9, 49, None, 200, "a.de", 1, None, None, None), False, None),
    ],
)
def test_check_rules(spark, page, usable, reason):
    got = quality.check_pages(spark.createDataFrame([page], PAGE), F.lit("a.de"), Quality()).first()
    assert (got["usable_for_analysis"], got["exclusion_reason"]) == (usable, reason)


def test_duplicates_summary_sample_upsert(spark):
    p = spark.createDataFrame([(1, "h"), (2, "h"), (3, None), (4, None), (5, "g")], "k int, content_hash string")
    assert [r["k"] for r in quality.flag_duplicates(p, ["k"], []).where("duplicate_content_flag").collect()] == [2]
    shots = schemas.conform(spark.createDataFrame([("1", "event", "selected"), ("2", "event", "not_found")], "firm_id string, relative_timepoint string, snapshot_status string"), schemas.SNAPSHOTS)
    pages = schemas.conform(spark.createDataFrame([("1", "event", 200, True, 10, True), ("1", "event", 404, False, 0, None)], "firm_id string, relative_timepoint string, http_status int, usable_for_analysis boolean, character_count int, soft_404_flag boolean"), schemas.PAGES)
    got = {r["firm_id"]: r for r in quality.summarize(shots, pages).collect()}
    assert (got["1"]["pages_attempted"], got["1"]["pages_success"], got["1"]["pages_usable"], got["1"]["avg_text_chars"], got["1"]["flags"]) == (2, 1, 1, 10.0, '["soft_404_flag"]')
    assert (got["2"]["pages_attempted"], got["2"]["avg_text_chars"], got["2"]["flags"]) == (0, 0.0, None)
    assert quality.review_sample(pages, 1).count() == 1 and quality.review_sample(pages, 15).count() == 2 and quality.review_sample(pages.limit(0)).count() == 0
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z", 1)], "k int, v string, w int")
    assert {tuple(r) for r in tables.upsert(a, b, ["k"]).collect()} == {(1, "x", None), (2, "z", 1)}


def model(seed, domain, pages, links, config):
    """Queue model of the traversal."""
    patterns = config.branding_path_patterns
    path = lambda u: u.split("/", 3)[3] if u.count("/") > 2 else ""

    def score(u):
        p = "/" + path(u)
        return sum((110 - i) for i, x in enumerate(patterns["de"]) if x in p) + sum((50 - i) for i, x in enumerate(patterns["en"]) if x in p) + max(0, 30 - len(p))

    queue, seen, out = [(seed, 0, None)], {seed}, []
    while queue and len(out) < config.max_pages_per_snapshot:
        u, depth, parent = queue.pop(0)
        out.append((u, depth, parent))
        if pages.get(u) != 200 or depth >= config.max_depth:
            continue
        new = []
        for i, v in enumerate(links.get(u, [])):
            if v not in seen and domain in v:
                seen.add(v)
                new.append((-score(v), len("/" + path(v)), i, v))
        queue += [(v, depth + 1, u) for *_, v in sorted(new)]
    return out


def test_crawl_equals_queue_model(spark):
    rng = random.Random(2)
    names = ["about", "presse", "x", "yy", "news/1", "karriere", "zzz", "werte", "a1", "b2"]
    config = Crawl(max_pages_per_snapshot=9)
    seeds, fetched, links, want = [], [], [], {}
    for s in range(12):
        nodes = ["http://a.de/"] + [f"http://a.de/{n}" for n in names] + ["http://b.de/q"]
        state = {u: rng.choice([200, 200, 200, 404]) for u in nodes}
        out = {u: [rng.choice(nodes) for _ in range(rng.randint(0, 5))] for u in nodes}
        seeds.append((str(s), nodes[0], "a.de"))
        fetched += [(str(s), u, c, True) for u, c in state.items()]
        links += [(str(s), u, i, v) for u, vs in out.items() for i, v in enumerate(vs)]
        want[str(s)] = model(nodes[0], "a.de", state, out, config)
    got = crawl.traverse(spark.createDataFrame(seeds, "snapshot_id string, url string, domain string"), spark.createDataFrame(fetched, "snapshot_id string, url string, status int, has_content boolean"), spark.createDataFrame(links, "snapshot_id string, url string, pos int, link string"), config)
    have = {}
    for r in got.orderBy("snapshot_id", "fetch_seq").collect():
        have.setdefault(r["snapshot_id"], []).append((r["url"], r["depth"], r["discovered_from_url"]))
    assert have == want


def test_run_end_to_end(spark):
    config = Config(top_n=1)
    firms = pipeline.prepare(spark.createDataFrame([(1, "TEST GMBH", 2015, "example.de", "https://www.example.de/")], "rank int, company string, event_year int, primary_domain string, website string"), config)
    index = spark.createDataFrame([("https://www.example.de/", 0, "20150615120000", "http://www.example.de/", "text/html", "200", "A")], "requested_url string, row_ord int, timestamp string, original string, mimetype string, statuscode string, digest string")
    index = index.selectExpr("requested_url", "row_ord", "'k' as urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "'1' as length", "'-' as redirect")
    shots = pipeline.discover(firms, index, config, "2026-07-13T00:00:00").cache()
    assert {r["snapshot_status"]: r["count"] for r in shots.groupBy("snapshot_status").count().collect()} == {"selected": 2, "beyond_tolerance": 3} or shots.where("snapshot_status = 'selected'").count() >= 1
    body = lambda t: bytearray(f'<html><body><a href="/ueber-uns">u</a><p>{t}</p></body></html>'.encode())
    fetched = spark.createDataFrame([("1", "event", u, 200, body("wort " * 40 + u), f"h{i}") for i, u in enumerate(["http://www.example.de/", "http://www.example.de/ueber-uns"])], "firm_id string, relative_timepoint string, url string, http_status int, content binary, content_hash string")
    pages = pipeline.crawl_and_extract(shots, firms, fetched, config).cache()
    got = {r["original_archived_url"]: r for r in pages.where("relative_timepoint = 'event'").collect()}
    assert got["http://www.example.de/ueber-uns"]["crawl_depth"] == 1 and got["http://www.example.de/ueber-uns"]["usable_for_analysis"] and got["http://www.example.de/"]["page_priority_reason"] == "homepage"
    assert len(pages.columns) == 63 and pages.where("exclusion_reason = 'beyond_tolerance'").count() >= 1
    assert quality.summarize(shots, pages).count() == 5


def test_config_reads_other_section_names(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("run:\n  top_n: 7\n  input_csv: in/firms.csv\n  run_id: null\nsnapshot_selection:\n  tolerance_days: 90\n  prefer: [closest]\ncrawl:\n  mode: homepage_only\n  throttle_seconds: 2.0\nvisual:\n  enabled: true\n", encoding="utf-8")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = Config.from_yaml(path).resolve(tmp_path)
    assert (got.top_n, got.selection.tolerance_days, got.crawl.homepage_only, got.run_id) == (7, 90, True, "run")
    assert got.input_csv == str(tmp_path / "in/firms.csv") and got.reports_dir == str(tmp_path / "reports") and got.output_dir == str(tmp_path / "out")
    with pytest.warns(UserWarning, match="tolerance"):
        Config.from_dict({"selection": {"tolerance": 1}})
    assert Config.from_dict(None).selection.url_variants[1] == "http://www.{domain}/"


def test_nearest_counts_candidates_without_date(spark):
    captures_ = rows(spark, "20150615120000", "", "20150615120000", "20150621000000")
    got = asof.nearest(observed(spark, dt.date(2015, 6, 20)).withColumn("_row", F.lit(1)), captures_.withColumn("d", asof.capture_date(F.col("timestamp"))), ["firm_id"], "target_date", "d", 5, [F.col("r.seed_ord"), F.col("r.row_ord")]).first()
    assert (got["candidates"], got["near"], got["best"]["row_ord"]) == (4, 3, 3)


def test_html_stage_on_odd_pages(spark):
    for page in (b"<title>a<title>b</title>", b"<h2>x<h1>y</h2></h1><p>z", b"<script><p>no</p></script>", b"\xff\xfe<p>\xe4", b"<<<>>>", b"<html lang><meta name=description><link rel=canonical>"):
        html.metadata_of(page), html.text_of(page), html.read(page).links
    assert html.text_of(b"<nav>nur Menue</nav>") == {"extracted_text": "nur Menue", "extraction_method": "visible_text", "full_chars": 9, "language": None}
    dense = html.text_of(b'<html><meta http-equiv="Content-Language" content="de"><aside><p>Hier steht ein ganzer Satz mit mehr als zehn Worten in der Seitenleiste.</p><p><a>Eins zwei drei vier fuenf sechs sieben acht neun zehn</a></p></aside>')
    assert (dense["extraction_method"], dense["language"]) == ("dense_blocks", "de") and dense["extracted_text"].count("\n") == 0


def test_intermediate_tables_are_deleted(spark):
    from pathlib import Path

    from chronopanel import session

    with session.scratch(spark):
        got = session.materialise(spark.range(5).toDF("x"), "t")
        path = Path(got.inputFiles()[0].removeprefix("file://")).parent
        assert got.count() == 5 and path.exists()
    assert not path.exists() and session.discard(spark, 10**9) == 0

import base64
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from siftlark.llm import site_style, url_lists, warc

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 3}.example.com/a/{i}", f"<html><body><nav>m{i}</nav><article><h1>T{i}</h1><p>x &amp; y {i % 4}</p></article><footer>f</footer></body></html>") for i in range(20)]
    rows += [(50, "http://h.example.com/", None), (51, None, ""), (None, "nonsense", "<p>a</p>"), (3, rows[3][1], rows[3][2]), (60, "http://x.example.com", rows[5][2]), (61, "http://x.example.com", rows[5][2])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"host": F.lit("clash"), "digest": F.lit(1), "noise": F.lit("n"), "row_no": F.lit(0)})


def test_archive_round_trip(spark, pages):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    wanted = []
    for i, _, h in pages:
        payload = (h or "").encode()
        refers = first.get(h or "")
        again = refers is not None and i != refers
        wanted.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", refers if again else None))
    found = warc.archive_round_trip(frame(spark, pages)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert warc.archive_round_trip(frame(spark, [])).count() == 0


def test_frames_stand_alone_and_any_reader_unpacks_the_file(spark, pages, tmp_path):
    index = warc.write_archives(frame(spark, pages), tmp_path.as_uri(), frame_bytes=900).collect()
    assert len({(r.path, r.frame) for r in index}) > len({r.path for r in index})
    assert len({r.record_id for r in index}) == len(index) == len(pages)
    for r in index:
        headers, _ = warc.read_one(r.path, r.frame, r.frame_bytes, r.offset, r.length)
        assert headers.get("x-page-id") == (None if r.page_id is None else str(r.page_id)) and headers["warc-record-id"] == r.record_id
    for path in {r.path for r in index}:
        data = (tmp_path / path.rsplit("/", 1)[1]).read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == sum(r.path == path for r in index)


def test_revisits_start_at_a_size(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc" * 10), (4, "u", "abc" * 10)]
    found = {r.page_id: r.record_type for r in warc.archive_round_trip(frame(spark, rows), revisit_from=10).collect()}
    assert found == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_markup(spark):
    page = """<!doctype html><html><head><title>no</title><script>if(a<b)"</p>"</script></head><body class="has-sidebar"><header>site</header>
    <div class="cookie-notice">no</div><article class="post"><header><h1>Title &lt;1&gt;</h1></header><p>One<b>two</b>&nbsp; three<p>four<ul><li>a<li>b</ul><form>no</form>
    <aside>no</aside><section id="comments"><p>no</p></section>a &lt; b &amp c<!-- no --><p hidden>no</p></article><footer>no</footer><p>out"""
    wrapped = "<div class='layout has-sidebar'><div class='page-with-header'><article><p>kept</p></article></div><div class='sidebar'>no</div></div>"
    teaser = "<article class='card'>Other card</article><div class='story'><p>The story is here.</p><p>It goes on.</p></div>"
    rows = enumerate([page, "bare text", "<p", "<div>" * 3000 + "deep", wrapped, teaser])
    found = {r.page_id: r.text for r in site_style.extract_main_text(frame(spark, [(i, f"http://h{i}.org/", x) for i, x in rows])).collect()}
    assert found == {
        0: "Title <1>\nOnetwo three\nfour\na\nb\na < b & c", 1: "bare text", 2: "", 3: "deep", 4: "kept", 5: "Other card\nThe story is here.\nIt goes on.",
    }


def test_noise_comes_back_by_a_join_as_well(spark, pages, monkeypatch):
    told = sorted(map(tuple, site_style.extract_main_text(frame(spark, pages)).collect()), key=str)
    monkeypatch.setattr(site_style, "LISTED_NODES", 0)
    assert sorted(map(tuple, site_style.extract_main_text(frame(spark, pages)).collect()), key=str) == told


def test_importance_matches_brute_force(spark):
    """The formula over counted pages, written out for one host."""
    import math

    body = "<html><body><div class='a'>{0}</div><ul class='b'>{1}</ul><footer>foot {2}</footer></body></html>"
    rows = [(i, "http://s.org/", body.format("same" if i % 2 else f"own {i}", "<li>x</li>" * (1 + i % 3), i)) for i in range(12)]
    read = site_style.read_pages(frame(spark, rows)).cache()
    tree = {round(r.importance, 9) for r in site_style.style_tree(read).collect()}
    n = math.log(12)
    shared = 6 * 4 * math.log(6) / n
    chars = 6 * 4 + sum(len(f"own {i}") for i in range(0, 12, 2))
    a = 0.1 * 0 + 0.9 * (chars - shared) / chars
    li_sequences = 1 - 3 * 4 * math.log(4) / 12 / n
    width = sum(1 + i % 3 for i in range(12)) / 12
    li = (1 - 0.9**width) * li_sequences + 0.9**width * 0.0
    foot = 0.2 * (0.9 * 0.2)
    assert tree == {round(a, 9), round(li, 9), round(foot, 9)}


def test_site_style_tree_removes_templates_only(spark):
    """Without an article element, what the host's pages share goes and what is their own stays."""
    page = "<html><body><div class='top'>Shop of things</div><div class='body'><p>story {0}</p><p>more {0}</p></div><div class='legal'>All rights</div></body></html>"
    rows = [(i, "http://s.example.com/x", page.format(i)) for i in range(12)] + [(99, "http://alone.example.com/", page.format(99))]
    rows += [(200 + i, "http://twins.example.com/", page.format(7)) for i in range(3)]
    found = {r.page_id: r.text for r in site_style.extract_main_text(frame(spark, rows)).collect()}
    assert all(found[i] == f"story {i}\nmore {i}" for i in range(12))
    assert found[99] == "Shop of things\nstory 99\nmore 99\nAll rights"
    assert found[200] == found[201] == "Shop of things\nstory 7\nmore 7\nAll rights"  # copies of a page are one page


def test_extraction_of_odd_pages(spark, pages):
    found = site_style.extract_main_text(frame(spark, pages)).collect()
    assert len(found) == len(pages) and all(r.n_chars == len(r.text) for r in found)
    texts = {r.page_id: r.text for r in found}
    assert texts[4] == "T4\nx & y 0" and texts[50] == "" and texts[51] == "" and texts[None] == "a"
    assert site_style.extract_main_text(frame(spark, [])).count() == 0


def brute_list(captures, events):
    order = {"block": 2, "allow": 1, "clear": 0}
    out = []
    for page, url, at in captures:
        found = []
        if url and "://" in url and at:
            host, _, path = url.split("://", 1)[1].partition("/")
            labels, parts = host.lower().split("."), [p for p in path.split("?")[0].split("/") if p]
            keys = [(k, "domain:" + ".".join(labels[-k:])) for k in range(1, len(labels) + 1)] + [(10**6, "host:" + host.lower())]
            keys += [(2 * 10**6 + k, f"path:{host.lower()}/" + "/".join(parts[:k])) for k in range(1, len(parts) + 1)]
            for rank, key in keys:
                past = [(d, order[a], a) for e, a, d in events if e == key and d is not None and d <= at]
                if past and max(past)[2] != "clear":
                    found.append((rank, key, max(past)[2]))
        best = max(found, default=(0, None, None))
        out.append((page, len(found), best[1], best[2], best[2] != "block"))
    return out


@pytest.mark.parametrize("listed, heavy", [(200_000, 1000), (0, 1000), (0, 20)])
def test_temporal_join_matches_brute_force(spark, monkeypatch, listed, heavy):
    """With a list that goes to every task, by joins, and with keys that are dealt over parts."""
    import datetime
    import random

    monkeypatch.setattr(url_lists, "LISTED", listed)
    monkeypatch.setattr(url_lists, "HEAVY_GROUPS", heavy)

    draw = random.Random(4)
    day = lambda: datetime.datetime(2023, 11, 1) + datetime.timedelta(hours=draw.randrange(24 * 150))
    entries = ["domain:example.com", "domain:com", "host:a.example.com", "path:a.example.com/x", "path:a.example.com/x/y", "host:b.example.com"]
    events = [(draw.choice(entries), draw.choice(["block", "allow", "clear"]), day()) for _ in range(60)]
    same = datetime.datetime(2024, 1, 5)
    events += [("host:b.example.com", "allow", same), ("host:b.example.com", "block", same), events[0], (None, "block", same), ("host:x", "block", None)]
    captures = [(i, draw.choice(["http://a.example.com/x/y/z?q", "https://A.example.com/x", "http://b.example.com", "http://other.org/x", "bad", None]), day()) for i in range(80)]
    captures += [(90, "http://b.example.com/", same), (91, "http://b.example.com/", None), captures[0]]
    frame_of = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumn("entry", F.lit("clash"))
    log = spark.createDataFrame(events, "entry string, action string, dated timestamp")
    found = [(r.page_id, r.n_active, r.entry, r.action, r.kept) for r in url_lists.evaluate(frame_of, log).collect()]
    assert sorted(found, key=str) == sorted(brute_list(captures, [e for e in events if e[0]]), key=str)
    assert url_lists.evaluate(frame_of.limit(0), log).count() == 0
    assert all(r.kept for r in url_lists.evaluate(frame_of, log.limit(0)).collect())


def test_very_long_payloads_and_urls(spark):
    long = "x" * 3_000_000
    rows = [(1, "http://a.example.com/" + "p/" * 3000, long), (2, "http://b.example.com/", long)]
    found = {r.page_id: r for r in warc.archive_round_trip(frame(spark, rows)).collect()}
    assert found[1].payload_bytes == found[2].payload_bytes == 3_000_000 and found[2].refers_to == 1
    captures = spark.createDataFrame(rows, SCHEMA).selectExpr("page_id", "url", "timestamp'2024-01-01' AS fetched_at")
    listed = spark.createDataFrame([("path:a.example.com/p/p", "block")], "entry string, action string").selectExpr("*", "timestamp'2023-01-01' AS dated")
    assert {r.page_id: r.kept for r in url_lists.evaluate(captures, listed).collect()} == {1: False, 2: True}


def texts_of(spark, pages):
    rows = [(i, f"http://h{i}.org/", x) for i, x in enumerate(pages)]
    return [r.text for r in site_style.extract_main_text(frame(spark, rows)).orderBy("page_id").collect()]


def test_inline_elements_take_no_words_out_of_a_line(spark):
    line = 'We discuss <span class="social">social media</span>, <a class="related">related work</a>, <b id="share">how to share</b>, <button>buttons</button> and <i aria-hidden="true">icons</i> here.'
    whole = "We discuss social media, related work, how to share, buttons and icons here."
    alone = '<div>Story one.</div><div><a class="social">Follow us</a> <button>Now</button></div><span class="advert"><div>Buy</div></span><p>Story <em class="promo">two</em>.</p>'
    assert texts_of(spark, [f"<p>{line}</p>", f"<article><p>{line}</p></article>", f"<div>{line}</div>", alone]) == [whole, whole, whole, "Story one.\nStory two."]


def test_nested_blocks_are_read_in_linear_time(spark):
    import time

    from siftlark.llm.markup import read_blocks

    for piece in ('<div class="row"><p>x</p>', "<div>x", "<ul><li>x", "<table><tr><td><p>x", "<span class='social'><div>x</div>"):
        began = time.perf_counter()
        blocks, nodes = read_blocks(piece * 20_000)
        assert len(blocks) == 20_000 and time.perf_counter() - began < 2, piece
    deep = '<div class="row"><p>x</p>' * 3000
    assert texts_of(spark, [deep]) == ["\n".join(["x"] * 3000)]


def test_what_is_important_below_keeps_what_is_above_at_any_depth(spark):
    """All pages share the outer line, which stays only where something of its own stands below it, however deep."""
    page = "<div class='a'>shared line{1}<p>{0}</p>"
    rows = [(i, f"http://{d}.org/{i}", page.format(f"own {i}" if d != "same" else "same", "<div>" * depth)) for d, depth in (("flat", 1), ("deep", 37), ("same", 5)) for i in range(8)]
    found = {(r.page_id, r.url.split("/")[2]): r.text for r in site_style.extract_main_text(frame(spark, rows)).collect()}
    assert found[3, "flat.org"] == found[3, "deep.org"] == "shared line\nown 3"
    links = spark.createDataFrame([(k, k - 1, k + 1) for k in range(1, 50)], "node long, parent long, depth int")
    assert {r.node for r in site_style.nodes_above(links, spark.createDataFrame([(23,)], "node long")).collect()} == set(range(24))

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import html, warc
from calibra.llm.tables import scratch, table

PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div>{body}<footer>foot</footer></body></html>"


def lines(body):
    return [(k, t) for k, t in html.lines_of(PAGE.format(body=body)) if k != html.BOILER]


def test_article_blocks():
    got = lines("<article><h1>Head &amp; line</h1><p><b>One<br>two<br><p>Three\n  four</p><ul><li>five<li>six</ul><div class=comments><p>nice</p></div></article><p>outside</p>")
    assert got == [(html.MAIN, t) for t in ("Head & line", "One two", "Three four", "five", "six")]


def test_without_article_lines_are_doubtful():
    assert lines("<p>text</p><aside>side</aside><form><p>name</p></form><div id='cookie-notice'>ok?</div>") == [(html.DOUBTFUL, "text")]


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<p", "<p>a<b>c</p></b>", "<!-- open", "<script>x", "a &lt;b&gt; &nope; &#x41; c", "<article><p>x</article></article>", '<p title="a>b">q</p>', "<table><tr><td>a<td>b<tr><td>c</table>"])
def test_any_page_can_be_read(page):
    assert all(t == t.strip() and t for _, t in html.lines_of(page))


def test_wrappers_beside_a_sidebar_are_kept():
    assert lines("<div class='page has-sidebar'><p>one</p></div><div class='site-menu'>two</div><div class='banner-top'><main><p>three</p></main></div>") == [(html.MAIN, "three")]
    assert lines("<div class='page has-sidebar'><p>one</p></div><div class='site-menu'>two</div>") == [(html.DOUBTFUL, "one")]


def test_references_are_decoded():
    assert html.lines_of("a &lt;b&gt; &#x41; &eacute;")[0][1] == "a <b> A é"


def site(n, host="h.example"):
    return [(i, f"http://{host}/a/{i:03d}", f"<body><div>Welcome to our site</div><p>page number {i} has a text of its own that is long enough</p><div>Call us</div></body>") for i in range(n)]


@pytest.mark.parametrize("partitions", ["1", "5", "40"])
def test_template_lines_go_at_any_partitioning(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = site(30) + [(100, None, None), (101, "http://[bad", "<p>x"), (102, "http://lone.example/", "<p>Welcome to our site</p>"), (None, "http://h.example/a/003", site(4)[3][2])]
        got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i in range(30):
        assert got[i] == f"page number {i} has a text of its own that is long enough"
    assert got[100] == "" and got[101] == "x" and got[102] == "Welcome to our site" and got[None] == got[3]


def test_copies_are_not_template(spark):
    body = "<body><p>same long text on both pages, word for word</p></body>"
    rows = [(1, "http://h.example/a", body), (2, "http://h.example/b", body)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"same long text on both pages, word for word"}


def test_common_subsequence():
    assert html.common_subsequence([1, 2, 3, 4], [2, 9, 4]) == {1, 3}
    assert html.common_subsequence([1, 2], []) == set()
    assert len(html.common_subsequence([1, 2, 1, 2], [2, 1, 2, 1])) == 3


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("cells", [1, 20, 1 << 20])
def test_alignment_against_brute_force(cells):
    rng = random.Random(cells)
    for _ in range(200):
        a, b = ([rng.randrange(rng.choice((2, 6, 30))) for _ in range(rng.randrange(25))] for _ in range(2))
        places = sorted(html.common_subsequence(a, b, cells))
        assert len(places) == length(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in places)  # in order


def test_long_alignments_need_linear_memory():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 50, 6000).tolist() for _ in range(2))
    tracemalloc.start()
    html.common_subsequence(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # the whole table has 144 MB


def brute_texts(rows, lists):
    """Texts by looking through each host's pages one by one."""
    parsed = {}
    for _, url, page in rows:
        (host, path), lines = html.place_of(url), html.lines_of(page, lists)
        key = host, page or ""
        parsed[key] = min(parsed.get(key, (path, lines)), (path, lines), key=lambda v: v[0])
    order = sorted(parsed, key=lambda k: (k[0], parsed[k][0], html.page_key(*k)))
    texts = {}
    for n, key in enumerate(order):
        lines, gone = parsed[key][1], set()
        for side in (order[max(n - html.NEAR, 0) : n][::-1], order[n + 1 : n + 1 + html.NEAR]):
            for other in side:
                if other[0] != key[0]:
                    break
                shared = html.common_subsequence([hash(t) for _, t in lines], [hash(t) for _, t in parsed[other][1]])
                if 2 * sum(len(lines[i][1]) for i in shared) <= sum(len(t) for _, t in lines) and [t for _, t in lines] != [t for _, t in parsed[other][1]]:
                    gone |= {i for i in shared if lines[i][0] != html.MAIN}
                    break
        texts[key] = "\n\n".join(t for i, (kind, t) in enumerate(lines) if kind != html.BOILER and i not in gone)
    return [(page_id, texts[html.place_of(url)[0], page or ""]) for page_id, url, page in rows]


@pytest.mark.parametrize("lists", [True, False])
def test_texts_against_brute_force(spark, sf, lists):
    rng = random.Random(4)
    rows = [tuple(r) for r in table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    for i in range(400):  # one host of many pages that mark no article; menus, copies and near copies
        body = "".join(f"<p>{rng.choice(['Home', 'About us', 'News', f'text {rng.randrange(60)} of some length here'])}</p>" for _ in range(rng.randrange(6)))
        rows.append((10_000 + i, f"http://big.example/{rng.randrange(300)}", rng.choice([body, f"<body><nav>x</nav>{body}</body>", rows[-1][2]])))
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), lists)
    assert sorted((r["page_id"], r["text"]) for r in got.collect()) == sorted(brute_texts(rows, lists))


def test_a_run_of_copies_is_looked_past(spark):
    page = "<body><div>Welcome</div><p>the same long text again, {}</p></body>"
    rows = [(i, f"http://h.example/{i}", page.format("" if 0 < i < 4 else f"or rather another one, number {i}")) for i in range(5)]
    rows += [(10 + i, f"http://g.example/{i}", f"<body><p>first line of the copies {i}</p><p>a second line which is much longer than the others</p></body>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Welcome" not in got[i] for i in range(5))
    assert all("second line" in got[10 + i] for i in range(3))


def test_differencing_works_without_markup_lists(spark):
    """On the tables' own pages lines are deleted, and the article survives with no element, role or class list at all."""
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    held = html.extract(pages).withColumnRenamed("text", "full").select("page_id", "full")
    got = html.extract(pages, lists=False)
    assert got.agg(F.sum("n_template")).first()[0] > 300
    both = got.join(held, "page_id").select(F.split("text", "\n\n").alias("a"), F.split("full", "\n\n").alias("b"))
    assert both.where(F.size(F.array_except("b", "a")) > 0).isEmpty()


def test_columns_of_clashing_names(spark):
    rows = [(1, "http://h.example/a", "<p>one", "x", 7, [1]), (2, "http://h.example/b", "<p>two", "y", 8, [2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int, gone array<int>").withColumn("page", F.lit(1)).withColumn("lines", F.lit(2))
    assert {(r["page_id"], r["text"]) for r in html.extract(df).collect()} == {(1, "one"), (2, "two")}
    path = scratch(spark, "warc-clash")
    warc.write_archives(df.withColumn("same", F.lit(1)).withColumn("refers_to", F.lit(5)), path)
    assert warc.reassemble(warc.read_records(spark, path)).where("intact AND payload_bytes = 6").count() == 2


def test_pages_of_the_tables(spark, sf):
    got = html.op5_html(spark, sf)
    pages = table(spark, sf, "pages")
    assert got.count() == pages.count() and got.where("n_chars = 0").isEmpty()
    assert html.extract(pages.limit(0)).count() == 0


# ---- WARC ---------------------------------------------------------------------------------
def test_chunk_framing():
    for payload in (b"", b"x", b"abc" * 9000):
        assert warc.unframe(warc.frame(payload, 100)) == payload
    with pytest.raises(ValueError):
        warc.unframe(b"5\r\nab")
    assert warc.unframe(b"2;ext=1\r\nab\r\n0\r\nTrailer: x\r\n\r\n") == b"ab"


def test_parse_reads_what_record_writes():
    data = b"".join(warc.page_records("7", "http://a/ü\r\nb", b"WARC/1.1\r\n\r\n" * 50, "2024-01-01T00:00:00Z", segment=300))
    got = list(warc.parse(data))
    assert [h["warc-type"] for h, _ in got] == ["response"] + ["continuation"] * (len(got) - 1)
    assert warc.payload_of(b"".join(bytes(b) for _, b in got)) == b"WARC/1.1\r\n\r\n" * 50
    with pytest.raises(ValueError):
        list(warc.parse(data[:-5]))


def by_hand(kind, name, block, *more):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{name}>", "WARC-Date: 2020-02-02T00:00:00Z", f"WARC-Target-URI: http://h/{name}", *more, f"content-length:{len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_reads_archives_it_did_not_write(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    digest = "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    page = lambda name, *more: by_hand("response", name, http + b"body", "Content-Type: application/http; msgtype=response", digest, *more)
    records = [by_hand("warcinfo", "i", b"x: y\r\n"), by_hand("request", "q", b"GET /"), *(page(f"p{i}") for i in range(5))]
    (tmp_path / "each.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(records[2] + records[3]) + gzip.compress(b"") + gzip.compress(records[4]))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    whole = b"".join(gzip.compress(r) for r in records[2:])
    (tmp_path / "cut.warc.gz").write_bytes(whole[:-9])
    (tmp_path / "torn.warc.gz").write_bytes(gzip.compress(records[2]) + b"\x1f\x8bgarbage that is no member")
    (tmp_path / "wrong.warc").write_bytes(page("w").replace(b"body", b"bodx"))
    got = {}
    for file in tmp_path.iterdir():
        rows = warc.reassemble(warc.read_records(spark, f"file://{tmp_path}", file.name)).collect()
        got[file.name] = sorted((r["record_type"], r["url"], r["intact"], r["payload_digest"]) for r in rows if r["record_type"] != "damaged"), sum(r["record_type"] == "damaged" for r in rows)
    ok = [("response", f"http://h/p{i}", True, hashlib.sha1(b"body").hexdigest()) for i in range(5)]
    assert got["each.warc.gz"] == got["plain.warc"] == (ok, 0)
    assert got["two.warc.gz"] == (ok[:3], 0)
    assert got["cut.warc.gz"] == (ok[:4], 1) and got["torn.warc.gz"] == (ok[:1], 1)
    assert [r[2] for r in got["wrong.warc"][0]] == [False]


def test_archives_are_valid(spark):
    path = scratch(spark, "warc-valid")
    warc.write_archives(spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string"), path, segment=500, per_file=7)
    names, kinds, responses, revisits = [], [], {}, []
    for row in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect():
        data = bytes(row["content"])
        parts = [list(warc.parse(m)) for m in warc.members(data)]
        assert gzip.decompress(data) == b"".join(warc.members(data)) and all(len(p) == 1 for p in parts) and len(parts) <= 7
        heads = [h for [(h, _)] in parts]
        assert [h["warc-type"] for h in heads].index("warcinfo") == 0 and [h["warc-type"] for h in heads].count("warcinfo") == 1
        for h, block in (p[0] for p in parts):
            names.append(h["warc-record-id"])
            kinds.append(h["warc-type"])
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["warc-date"]) and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", names[-1])
            assert kinds[-1] == "warcinfo" or h["warc-target-uri"]
            if kinds[-1] == "response":
                responses[names[-1]] = h
            if kinds[-1] == "revisit":
                revisits.append(h)
            if kinds[-1] == "continuation":
                assert h["warc-segment-origin-id"] and int(h["warc-segment-number"]) > 1 and "content-type" not in h
    assert len(set(names)) == len(names) and set(kinds) == {"warcinfo", "response", "revisit", "continuation"}
    for h in revisits:  # every reference is to a response of the same payload
        other = responses[h["warc-refers-to"]]
        assert (other["warc-payload-digest"], other["warc-target-uri"], other["warc-date"]) == (h["warc-payload-digest"], h["warc-refers-to-target-uri"], h["warc-refers-to-date"])
        assert other["calibra-page-id"] == h["calibra-refers-to-page-id"]


def test_page_ids_of_text_with_slashes(spark):
    path = scratch(spark, "warc-names")
    pages = [(k, "http://h/", "x" * 2000) for k in ("a/b", "a/c", "None", "a b>\r\nü")]
    warc.write_archives(spark.createDataFrame(pages, "page_id string, url string, html string"), path)
    got = warc.reassemble(warc.read_records(spark, path), "string").collect()
    assert sorted((r["page_id"], r["refers_to"], r["intact"]) for r in got) == sorted((p[0], None if p[0] == "a/c" else "a/c", True) for p in pages)


ODD_PAGES = [(1, "u", None), (2, None, ""), (3, "u", "é" * 600), (4, "v", "é" * 600), (5, "v", "x" * 999), (6, "w", "x" * 999), (7, "w", "long " * 60_000), (8, "w", "long " * 60_000), (None, "z", "long " * 60_000), (9, "a b\n", "WARC/1.1\r\n" * 200), (4, "v", "é" * 600)]


@pytest.mark.parametrize("segment, per_file", [(1 << 16, 2000), (500, 3)])
def test_round_trip(spark, segment, per_file):
    path = scratch(spark, "warc-test")
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string")
    warc.write_archives(pages, path, segment=segment, per_file=per_file)
    got = sorted((repr(tuple(r)) for r in warc.reassemble(warc.read_records(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()))
    want = []
    for page, _, text in ODD_PAGES:
        data = (text or "").encode()
        same = [p for p, _, t in ODD_PAGES if (t or "").encode() == data and p is not None]
        revisit = len(data) >= 1000 and page != max(same)
        want.append(repr((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None, True)))
    assert got == sorted(want)


def test_damaged_segments_are_told(spark):
    records = spark.createDataFrame([("o", 1, "1", "u", "response", "d", None, None, None, None, bytearray(b"HTTP/1.1 200 OK\r\n\r\nab")), ("o", 3, "1", None, "continuation", "", None, 99, None, None, bytearray(b"c"))], "origin string, segment int, page string, url string, record_type string, digest string, refers_to string, total long, payload_bytes long, intact boolean, block binary")
    assert warc.reassemble(records).select("page_id", "intact").collect()[0] == (1, False)


def test_no_pages(spark):
    path = scratch(spark, "warc-empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.reassemble(warc.read_records(spark, path)).count() == 0

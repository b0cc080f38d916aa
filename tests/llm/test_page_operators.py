"""HTML extraction, URL filter, WARC, nearest neighbours, and the corpus pipeline."""

import gzip
import hashlib
import pathlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import work
from tidemill.llm import ann, html_extract, queries, url_filter, warc

ARTICLE = "<html><body><nav><a>menu</a></nav><p>site line</p><article><h1>T &amp; t</h1><p>one<br> two</p><div class='ad'>buy</div></article><p>more site<footer>f</footer></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    plain = lambda *ls: "<body>" + "".join(f"<p>{x}</p>" for x in ls) + "</body>"
    rows = [
        (1, "http://a.example/x/1", ARTICLE),
        (2, "http://a.example/x/2", plain("site line", "own 2", "more site")),
        (3, "http://A.example/x/3?q", plain("site line", "own 3", "more site")),
        (4, "http://b.example/only", plain("alone")),
        (5, None, None),
        (6, "no scheme", ""),
        (7, "http://c.example/p", plain("copy", "copy2")),
        (8, "http://c.example/q", plain("copy", "copy2")),
        (8, "http://c.example/q", plain("copy", "copy2")),
        (None, "http://d.example/" + "y" * 3000, plain(*["long line %d" % i for i in range(3000)])),
    ]
    return spark.createDataFrame([(*r, "h", True) for r in rows], "page_id long, url string, html string, host string, own boolean")


def test_lines_of():
    got = html_extract.lines_of('<header>site</header><div id="main-nav">x</div><p>One &lt;two&gt;<br>three <b>x</b>y</p>tail<ul><li>a<li>b</ul><script>1<2</script><div class="comments"><p>c</p></div><form><p>q</form>end<!-- c --><style>p{}')
    assert got == ["One <two> three xy", "tail", "a", "b", "end"]
    assert html_extract.lines_of(ARTICLE) == ["T & t", "one two"]
    assert html_extract.lines_of("") == [] and html_extract.lines_of("a<b") == ["a<b"]


def test_markup_names_candidates_only():
    got = html_extract.lines_of
    assert got('<main><h1>Real</h1><p>body text</p><article class="teaser">..related card..</article></main>') == ["Real", "body text"]
    assert got("<main><h1>Real</h1><p>a body text of some length</p><article>card</article></main>") == ["Real", "a body text of some length"]
    assert got('<article><p>one</p><div class="share-of-market"><p>real para</p></div><p id="ad-hoc">two</p><p class="has-sidebar">three</p></article>') == ["one", "real para", "two", "three"]
    assert got('<article><p>one</p><div class="reader-feedback">wow</div><div class="mainNav">n</div><div class="ad-2">n</div></article>') == ["one"]
    assert got("<main><article><p>first post</p></article><article><p>second post</p></article></main>") == ["first post", "second post"]
    assert got('<article class="comment">me too</article><article>text</article><article class="hentry">more</article>') == ["text", "more"]


def test_long_pages_are_aligned_in_halves(monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(html_extract, "CELLS", 6)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 30))] for _ in "ab")
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        taken = html_extract.shared_lines(a, b)
        rest = iter(b)
        assert sum(taken) == d[-1][-1] and all(x in rest for x, t in zip(a, taken) if t)
    monkeypatch.undo()
    many = [*range(30_000)]
    rng.shuffle(many)
    assert sum(html_extract.shared_lines(many[:15_000] + [1], [2] + many[:14_000])) >= 14_000


def test_whole_hosts_against_brute_force(spark):
    """Pairs and aligns every page of every host one by one; shared lines are unique in a page."""
    rng, rows = random.Random(12), []
    for host in range(4):
        site = [f"site {host} {i}" for i in range(8)]
        for page in range(25):
            lines = sorted(rng.sample(site, rng.randint(2, 8)))  # in one order on all pages, so that the alignment is unique
            k = len(lines) // 2
            top, inside, end = lines[:k], lines[k : k + 1], lines[k + 1 :]
            own = [f"own {host} {page} {i} " + "x" * 40 for i in range(rng.randint(1, 4))]
            tag = ("div", "main", "article")[page % 3]
            body = f"<{tag}>" + "".join(f"<p>{x}</p>" for x in own + inside) + f"</{tag}>"
            html = "".join(f"<p>{x}</p>" for x in top) + body + "".join(f"<footer>{x}</footer>" for x in end)
            rows.append((len(rows), f"http://h{host}.example/{rng.choice('ab')}/{rng.randint(0, 99)}", html, top, own + inside, end, tag))
    want = {}
    for host in range(4):
        mine = sorted((r for r in rows if r[1].startswith(f"http://h{host}.")), key=lambda r: (r[1], r[0]))
        for i, (pid, url, _, top, body, end, tag) in enumerate(mine):
            alike = lambda j: -1 if not 0 <= j < len(mine) else len(__import__("os").path.commonprefix([url[17:], mine[j][1][17:]]))  # noqa: B023, E731
            o = mine[i - 1] if alike(i - 1) >= alike(i + 1) else mine[i + 1]
            other = {*o[3], *o[4], *o[5]}
            want[pid] = "\n\n".join(x for x in (top + body if tag == "div" else body) if tag == "article" or x not in other)
    frame = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(frame).collect()}
    assert got == want


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in "ab")
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        taken = html_extract.shared_lines(a, b)
        rest = iter(b)
        assert sum(taken) == d[-1][-1] and all(x in rest for x, t in zip(a, taken) if t)


def test_extract(spark, pages):
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect())
    long = "\n\n".join("long line %d" % i for i in range(3000))
    want = [(1, "T & t\n\none two"), (2, "own 2"), (3, "own 3"), (4, "alone"), (5, ""), (6, ""), (7, "copy\n\ncopy2"), (8, "copy\n\ncopy2"), (8, "copy\n\ncopy2"), (None, long)]
    assert got == Counter((i, t, len(t)) for i, t in want)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_repeated_rows_are_one_page(spark):
    plain = lambda i: f"<p>site line</p><p>own {i}</p><p>more site</p>"
    rows = [(i, f"http://a.example/{i:03}", plain(i)) for i in range(40)]
    rows += rows[7:8] * 30 + rows[39:]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = Counter((r["page_id"], r["text"]) for r in html_extract.extract(frame).collect())
    assert got == Counter((i, f"own {i}") for i, _, _ in rows)


def test_texts_lie_on_disk_once(spark, tmp_path):
    """Shuffles and written tables together, over pages of text that hardly compresses."""
    rng = random.Random(13)
    page = lambda i: "<nav>menu</nav><article>" + "".join(f"<p>{rng.randbytes(60).hex()}</p>" for _ in range(20)) + f"</article><footer>{i}</footer>"
    rows = [(i, f"http://h{i % 7}.example/{i}", page(i)) for i in range(3000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.option("compression", "zstd").parquet(str(tmp_path / "pages"))
    size = lambda folder: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    shared = pathlib.Path(work.shared_dir(spark).removeprefix("file:"))
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = size(shared) + shuffled()
    found = html_extract.extract(spark.read.parquet(str(tmp_path / "pages")))
    found.write.parquet(str(tmp_path / "out"))
    used = size(shared) + shuffled() - before
    assert 0 < used < 1.5 * size(tmp_path / "pages")
    assert spark.read.parquet(str(tmp_path / "out")).where("n_chars > 2400").count() == 3000


def test_cascade_is_exact():
    rng = random.Random(2)
    keys = [f"k{i}" for i in range(5000)]
    for n in (0, 1, 30, 2500):
        listed = set(rng.sample(keys, n))
        made = url_filter.build(listed, len(keys) - n, lambda level: [k for k in keys if k not in listed and k in level])
        assert {k for k in keys if k in made} == listed


def test_judge_against_brute_force(spark, pages):
    rules = queries.URL_RULES
    urls = [r["url"] for r in pages.collect()] + [
        "https://www.EXAMPLE.com/en/1", "http://x.example.com/en/?a", "http://example.com", "http://com/", "http://a.net/es/", "http://a.net/ES/", "//net/fr/", "x://net/fr/z#", "http://free-bets.example.org/", "http://www.example.com/en", "http://notexample.com/en/", "://", "http://u@h.net/fr/\n",
    ]

    def brute(url):
        import re

        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1], m[2]) if m else ("", "")
        host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
        fits = []
        for verdict, listed in (("allow", rules.allow), ("block", rules.block)):
            for r in listed:
                h, _, p = r.partition("/")
                if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                    fits.append((-len(r), r, verdict))
        if fits:
            return (host, path, *min(fits)[1:])
        return host, path, None, "block" if set(host.split(".")) & set(rules.blocked_labels) else "allow"

    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(frame, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert url_filter.judge(frame.limit(0), rules).count() == 0


def test_judge_long_and_repeated_urls(spark):
    long = "http://" + "a." * 20_000 + "example.com/en/" + "x" * 1_000_000
    frame = spark.createDataFrame([(1, long), (1, long), (None, "http://spam-farm.org/"), (2, None)], "page_id long, url string")
    got = Counter((r["page_id"], len(r["path"]), r["rule"], r["verdict"]) for r in url_filter.judge(frame, queries.URL_RULES).collect())
    assert got == {(1, 1_000_004, "example.com/en/", "block"): 2, (None, 1, None, "block"): 1, (2, 0, None, "allow"): 1}


def test_warc_very_long_payloads_in_many_tasks(spark, monkeypatch):
    body = "0123456789abcdef" * 300_000  # 4.8 MB
    pages = spark.createDataFrame([(i, f"http://h/{i}", body if i < 3 else "p" * 2000 + str(i)) for i in range(12)], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "READ_BYTES", 1 << 10)
    monkeypatch.setattr(warc, "INDEX_BLOCKS", 2)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_and_read(pages).collect()}
    assert got[0] == (4_800_000, "revisit", 2) and got[2] == (4_800_000, "response", None) and len(got) == 12
    index = warc.build_index(warc.write_archive(pages), 1)
    assert len(index.parts) > 1  # one block a row: more than one index task


def test_warc_round_trip(spark, monkeypatch):
    rng = random.Random(3)
    body = ["", "short", "x" * 999, "y" * 1000, "é" * 600, "z" * 5000]
    rows = [(i, rng.choice([f"http://h{i % 5}.example/p{i % 7}", None, "http://x y/ü\r\nA: b"]), rng.choice(body)) for i in range(300)] + [(7, "http://dup/", None), (7, "http://dup/", None), (None, "http://n/", "y" * 1000), (299, "http://dup2/", "q" * 2000), (299, "http://dup2/", "q" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("file", F.lit("f"))
    largest = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            largest[h] = max(i, largest.get(h, -1))

    def want(i, h):
        data = (h or "").encode()
        other = largest.get(h) if len(data) >= 1000 and i != largest.get(h) else None
        return i, len(data), hashlib.sha1(data).hexdigest(), "response" if other is None else "revisit", other

    monkeypatch.setattr(warc, "BLOCK_ROWS", 4)
    manifest = warc.write_archive(pages)
    index = warc.build_index(manifest, 4)
    archive = manifest.head()["file"].rpartition("/")[0]
    got = warc.read_pages(pages, index, archive).collect()
    assert Counter(tuple(r) for r in got) == Counter(want(i, h) for i, _, h in rows)
    assert warc.archive_and_read(pages.limit(0)).count() == 0
    one = manifest.where("page_id = 3").head()
    with open(one["file"].removeprefix("file://"), "rb") as f:
        f.seek(one["offset"])
        data = f.read(one["length"])
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and warc.read_record(data).page_id == 3
    reader = warc.Reader(index, archive)
    assert reader.captures("nowhere)", 1) == [] and len(reader.captures(warc.url_key("http://dup/"), 7)) == 2


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 5000)] + 0.4 * rng.normal(size=(5000, 16))
    x[1000:2500] = x[0]  # one vector holds a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(6000, None), (6001, [0.0] * 16), (6002, [float("nan")] * 16), (6003, [1.0]), (None, [1.0] * 16), (6050, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").unionByName(spark.createDataFrame([rows[50]], "vec_id long, embedding array<double>"))
    small = ann.Settings(sample=2048, rows_a_part=400, block_rows=700, block_queries=30)
    got = ann.search(frame, lambda i: i % 50 == 0, settings=small).toPandas()
    unit, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    by = got.groupby("query_id")
    assert len(by) == 100 and (by.size() == 5).all()
    for q in range(0, 5000, 50):
        s = unit @ unit[q]
        s[q] = -9
        mine = by.get_group(q).sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(mine["score"], s[mine["vec_id"]], atol=1e-12)
        if 1000 <= q < 2500 or q == 0:
            assert mine["vec_id"].tolist() == [v for v in [0, *range(1000, 1006)] if v != q][:5]
        hit += (mine["score"].to_numpy() >= np.sort(s)[-5] - 1e-12).sum()
    assert hit / 500 >= 0.9
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<double>"), lambda i: i % 50 == 0)
    assert sorted(map(tuple, few.select("query_id", "rank", "vec_id", "score").collect())) == [(0, 1, 1, 1.0), (0, 2, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0)]
    assert ann.search(frame.limit(0), lambda i: i % 50 == 0).count() == 0


def test_every_table_is_partitioned_and_parts_may_be_parted(spark):
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(64, 24))
    x = centres[rng.integers(0, 64, 3000)] + 0.3 * rng.normal(size=(3000, 24))
    frame = spark.createDataFrame([(i, v.tolist(), "s", 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string, part int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(60), np.arange(0, 3000, 50)] = -9
    fifth = np.sort(near, axis=1)[:, -5]
    for settings, parts in ((ann.Settings(), 32), (ann.Settings(least_parts=4, rows_a_part=100, most_parts=4, sub_sample=512), 32)):
        found, router, scanned = ann.search_with_router(frame, lambda i: i % 50 == 0, settings=settings)
        got = found.toPandas()
        assert router.parts == parts and router.probes < parts and scanned <= 1 / 3
        assert (got["score"].to_numpy() >= fifth[got["query_id"] // 50] - 1e-12).mean() >= 0.9 and len(got) == 300


def test_balanced_parts():
    x = np.random.default_rng(5).normal(size=(512, 8))
    label = ann.balanced_parts(ann.neighbour_graph(x / np.linalg.norm(x, axis=1, keepdims=True), 8), 3)
    assert np.bincount(label).tolist() == [64] * 8


def test_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60))
    clean, passage = [line() for _ in range(12)], " ".join(f"shared{i}" for i in range(60))
    near = clean[0].rsplit(" ", 1)[0] + " changed"
    texts = [*clean, clean[1], near, "too short", "spam " * 80, line() + " " + passage, passage + " " + line(), None]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stages, kept = dict(corpus_pipeline.STAGES), docs
    seen = {}
    for name in ("quality_rules", "near_duplicates", "repeated_passages", "source_mix"):
        kept = stages[name](spark, kept, "")
        assert kept.columns == docs.columns
        seen[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    assert set(seen["quality_rules"]) == set(range(19)) - {14, 15, 18}
    assert set(seen["near_duplicates"]) == set(range(12)) | {16, 17}
    assert all("shared30" not in t for t in seen["repeated_passages"].values()) and all(seen["repeated_passages"][i] == clean[i] for i in range(12))
    assert set(seen["source_mix"]) < set(seen["near_duplicates"]) and len(seen["source_mix"]) >= 10
    out = stages["token_ids"](spark, kept, "").collect()
    assert {(r["doc_id"], r["decoded_sha256"]) for r in out} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in seen["source_mix"].items()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0

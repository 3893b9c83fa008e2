"""Operators 6 and 8, the queries and the pipeline."""

import gzip
import importlib
import random
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from mosaique.llm import html_extract, warc
from mosaique.llm.html_blocks import blocks
from mosaique.llm.queries import QUERIES, SQL


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("<p>a", ["a"]),
        ("<article><h1>T &amp; U</h1><p>x <b>y</b>\n z<br>w</p><p></p></article><p>out", ["T & U", "x y z", "w"]),
        ("<nav>n</nav><main><header>h</header><p>m</p><aside>s</aside><footer>f</footer></main>", ["m"]),
        ("<article><script>var a='</p>';</script><style>p{}</style><!-- c <p>no</p> --><p>t</p></article>", ["t"]),
        ("<article><p>a</p><div class='share-buttons'>s</div><section id=comments><article>c</article></section><p>b</article>", ["a", "b"]),
        ("<article><p>caf&eacute; &#233; &#x263A; &nbsp; &lt;i&gt;</p><form>f <input></form></article>", ["café é ☺ <i>"]),
        ("<ARTICLE CLASS=ad><P>One <P>Two <LI>3<LI>4</ARTICLE>", ["One", "Two", "3", "4"]),
        ("<article><p>cut <b>off", ["cut off"]),
        ("<article><p>tag <a href=\"x>y\">in > quotes</a> <", ["tag in > quotes <"]),
        ("<main><p title=don't>hello world</p><p>it's fine</p></main>", ["hello world", "it's fine"]),
        ("<main><p title=\"never closed>hello</p><p>more</p></main>", ["hello", "more"]),
        ("<main><p title = 'a > b' class=x>hello</p><p data-x='class=ad' title=\"id=menu\">stays</p><p class = ad>gone</p></main>", ["hello", "stays"]),
    ],
)
def test_blocks(page, want):
    found = blocks(page)
    assert [b.text for b in found if (b.main or not any(x.main for x in found)) and not b.noise] == want


def test_deep_and_unclosed_pages():
    import time

    began = time.perf_counter()
    deep = "<b>" * 30_000 + "<div>" * 30_000 + "text" + "</b></p></i>" * 30_000 + "<nav>" * 2000 + "menu" + "</span></nav>" * 2000 + "<p>end"
    assert [(b.text, b.noise) for b in blocks(deep)] == [("text", False), ("menu", True), ("end", False)]
    assert [b.text for b in blocks("<p title='" * 20_000 + ">x")] == ["x"]
    assert time.perf_counter() - began < 20


def brute_repeated(streams, run):
    pages = list(dict.fromkeys(tuple(s) for s in streams))
    seen = {}
    for n, s in enumerate(pages):
        for i in range(len(s) - run + 1):
            seen.setdefault(s[i : i + run], set()).add(n)
    out = []
    for s in streams:
        mask = [False] * len(s)
        for i in range(len(s) - run + 1):
            if len(seen[tuple(s[i : i + run])]) > 1:
                mask[i : i + run] = [True] * run
        out.append(mask)
    return out


@pytest.mark.parametrize("run", [1, 2, 4, 8])
def test_repeated_runs(run):
    rng = random.Random(run)
    streams = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(8)] + [[]] + [list("abcabcabc" * 3)] * 2
    assert [m.tolist() for m in html_extract.repeated(streams, run)] == brute_repeated(streams, run)


def test_boilerplate_without_article(spark):
    menu, foot = "Home News Sport Weather Money Travel Food Shop Log in", "All rights reserved by the people of this web site since 1999"
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><div>Story {i} has its own words number {i * 7} and more of them {i}</div><div>{foot}</div>", "t") for i in range(6)]
    rows += [(20, None, None, "t"), (21, "no url", "<p>x</p>", "t"), (22, "http://h.example/0", rows[0][2], "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for i in range(6):
        assert got[i]["text"] == f"Story {i} has its own words number {i * 7} and more of them {i}"
    assert got[22]["text"] == got[0]["text"] and got[20]["text"] == "" and got[21]["text"] == "x" and got[0]["n_chars"] == len(got[0]["text"])
    assert html_extract.extract(pages.filter("false")).count() == 0


def test_large_host_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "PAGES", 10)
    pages = spark.range(95).selectExpr("id AS page_id", "'http://one.example/' || id AS url", "'<article><p>page ' || id || '</p></article>' AS html")
    assert {(r["page_id"], r["text"]) for r in html_extract.extract(pages).collect()} == {(i, f"page {i}") for i in range(95)}


def test_story_beside_an_article(spark):
    menu = "Home News Sport Weather Money Travel Food Shop Log in"
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><div>Story {i} of its own words {i * 7}</div><article>Teaser {i}</article>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == {i: f"Story {i} of its own words {i * 7} Teaser {i}" for i in range(4)}


def test_article_text_is_content_wherever_it_is_reprinted(spark):
    story, notice = " ".join(f"word{i}" for i in range(30)), "we use small files on this site to count visits"
    rows = [
        (0, "http://h.example/0", f"<article><p>{story}</p></article><div>{notice}</div>"),
        (1, "http://h.example/1", f"<div>{story}</div><div class=notice>{notice}</div>"),
        (2, "http://h.example/2", f"<main>{story}</main>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == {0: story, 1: story, 2: story}


def test_hosts_of_200_and_2000_pages_agree(spark):
    def pages(n, start):
        rows = []
        for i in range(n):  # pages 2 k and 2 k + 1 share a run of 12 words
            pair = " ".join(f"s{i // 2}x{k}" for k in range(12))
            own = " ".join(f"o{i}y{k}" for k in range(9))
            rows.append((start + i, f"http://host{n}.example/{i}", f"<div>{own}</div><div>{pair}</div>"))
        return rows

    rows = spark.createDataFrame(pages(200, 0) + pages(2000, 1000), "page_id long, url string, html string")
    got = html_extract.extract(rows).collect()
    assert len(got) == 2200 and not [r["page_id"] for r in got if "x" in r["text"] or not r["text"].startswith("o")]


def test_large_host_is_as_one_array(spark, monkeypatch):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(n))
    notice, menu, copy = prose(12), prose(9), prose(40)
    rows = [(i, f"http://one.example/{i}", f"<div>{menu}</div><div>{prose(rng.randint(0, 60))}</div><p>{notice if i in (3, 77) else 'x'}</p>") for i in range(90)]
    rows += [(i, f"http://one.example/{i}", f"<p class=c{i}>{copy}</p>") for i in range(90, 95)] + [(95, "http://one.example/95", None), (96, "http://two.example/", f"<p>{notice}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    monkeypatch.setattr(html_extract, "PAGES", 2)  # 49 groups, 4 buckets
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == whole
    assert notice not in whole[3] and whole[90] == whole[94] == copy and whole[96] == notice


def test_extraction_of_the_table(spark, sf_dir):
    import html as entities

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op6_html_extract"](spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inner))
        assert r["text"] == " ".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_canonical_url(spark):
    same = ["http://www.a.example:80/p/?b=2&a=1#x", "https://A.example/p?a=1&b=2&utm_source=q", "a.example/p/?a=1&b=2&ref=z"]
    rows = spark.createDataFrame([(u,) for u in [*same, "http://a.example/q", None, ""]], "u string")
    got = [r[0] for r in rows.select(warc.canonical_url(rows["u"])).collect()]
    assert got == ["a.example/p?a=1&b=2"] * 3 + ["a.example/q", None, ""]


def test_revisits(spark):
    from datetime import datetime

    at = lambda h: datetime(2024, 1, 1, h)
    rows = [
        ("r1", "response", "http://x.example/", at(1), 200, {"ETag": '"a"', "Server": "s", "Date": "d1"}, b"one", 1),
        ("r2", "response", "http://x.example", at(3), 200, {"etag": '"b"'}, b"two", 1),
        ("v1", "revisit", "https://www.x.example/", at(2), 304, {"etag": 'W/"a"', "date": "d2", "server": "edge"}, None, 1),
        ("v2", "revisit", "x.example", at(4), 304, {"etag": '"a"'}, None, 1),
        ("v3", "revisit", "http://x.example/", at(0), 304, {}, None, 1),
        ("v4", "revisit", "http://x.example/", at(5), 304, None, None, 1),
        ("v5", "revisit", None, at(5), 304, {}, None, 1),
        ("v6", "revisit", "http://x.example/", None, 304, {}, None, 1),
        ("e1", "response", "http://x.example/", at(6), 500, {}, b"bad", 1),
        ("v7", "revisit", "http://x.example/", at(7), 304, {}, None, 1),
        ("m1", "response", "http://m.example/", at(1), 200, {"last-modified": "x"}, b"m", 1),
        ("v8", "revisit", "http://m.example/", at(2), 304, {"last-modified": "y"}, None, 1),
        (None, "response", "http://n.example/", at(1), 200, {}, b"n", 1),
    ]
    records = spark.createDataFrame(rows, warc.RECORD_SCHEMA + ", canonical int")
    got = {r["record_id"]: r for r in warc.resolve_revisits(records.union(records.filter("record_id = 'v1'"))).collect()}
    say = {k: (r["outcome"], r["source_id"]) for k, r in got.items()}
    assert say == {
        "r1": ("full", None), "r2": ("full", None), "e1": ("full", None), "m1": ("full", None), None: ("full", None),
        "v1": ("resolved", "r1"), "v2": ("validators differ", "r2"), "v3": ("no earlier response", None), "v4": ("resolved unvalidated", "r2"),
        "v5": ("no earlier response", None), "v6": ("no earlier response", None), "v7": ("resolved unvalidated", "r2"), "v8": ("validators differ", "m1"),
    }
    assert got["v1"]["headers"] == {"etag": 'W/"a"', "date": "d2", "server": "s"} and bytes(got["v1"]["payload"]) == b"one" and got["v1"]["status"] == 200
    assert got["v2"]["payload"] is None and got["v2"]["status"] == 304
    assert warc.resolve_revisits(records.filter("false")).count() == 0


def test_revisits_of_one_hot_url(spark):
    rows = spark.range(900).selectExpr(
        "CAST(id AS string) AS record_id", "IF(id % 100 = 0, 'response', 'revisit') AS record_type", "'http://hot.example/' AS url",
        "timestamp_seconds(id) AS captured", "200 AS status", "CAST(map() AS map<string,string>) AS headers", "CAST(CAST(id AS string) AS binary) AS payload",
    )
    got = warc.resolve_revisits(rows).filter("record_type = 'revisit'").collect()
    assert len(got) == 891 and all(int(r["source_id"]) == int(r["record_id"]) // 100 * 100 and r["outcome"] == "resolved unvalidated" for r in got)


def test_revisits_keep_columns_of_any_name(spark):
    names = "differ, _s, _h, _p, etag, modified, _part, _seen, _found, carry, part, id, at, full, asks, seen, old, profile".split(", ")
    records = spark.createDataFrame(
        [("r", "response", "http://x.example/", None, 200, {"etag": "a"}, b"body"), ("v", "revisit", "http://x.example/", None, 304, {"etag": "a"}, None), ("w", "revisit", "http://x.example/", None, 304, {}, None)],
        warc.RECORD_SCHEMA,
    ).selectExpr("* EXCEPT (captured)", "IF(record_id = 'r', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02') AS captured", *(f"record_id || '{n}' AS {n}" for n in names[:-1]),
                 "IF(record_id = 'w', 'http://netpreserve.org/warc/1.1/revisit/identical-payload-digest', NULL) AS profile")
    got = {r["record_id"]: r for r in warc.resolve_revisits(records).collect()}
    assert all(got[k][n] == k + n for k in "rvw" for n in names[:-1])
    assert {k: (r["outcome"], r["payload"] and bytes(r["payload"])) for k, r in got.items()} == {"r": ("full", b"body"), "v": ("resolved", b"body"), "w": ("other profile", None)}


def test_broken_warc_files():
    record = warc.format_record("<u:1>", "response", "http://a.example/", "2024-01-01T00:00:00Z", 200, {"A": "1"}, b"body" * 400)
    packed = gzip.compress(record)
    names = lambda data: [r["record_id"] for r in warc.parse_records(data)]
    assert names(packed + packed[: len(packed) // 2]) == ["<u:1>"] and names(packed + b"\x1f\x8bgarbage") == ["<u:1>"] and names(gzip.compress(record + record)) == ["<u:1>"] * 2
    assert names(packed[:20]) == names(b"") == names(b"\x1f\x8b") == names(b"WARC/1.1\r\nno-length: 1\r\n\r\n") == []
    half = len(record) // 2
    assert names(gzip.compress(record[:half]) + gzip.compress(record[half:])) == ["<u:1>"]
    http = b"HTTP/1.1 200 OK\r\nVary: a\r\nvary: b\r\nSet-Cookie: x=1, y\r\nset-cookie: z\r\n\r\nbody"
    found = next(warc.parse_records(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Profile: p\r\nContent-Length: %d\r\n\r\n" % len(http) + http))
    assert found["headers"] == [("vary", "a, b"), ("set-cookie", "x=1, y\nz")] and found["payload"] == b"body" and found["profile"] == "p"


def test_warc_files(spark, tmp_path):
    record = warc.format_record("<u:1>", "response", "http://a.example/", "2024-01-01T00:00:00Z", 200, {"ETag": '"x"'}, b"body\r\n\r\nmore")
    revisit = warc.format_record("<u:2>", "revisit", "http://a.example/", "2024-01-02T00:00:00Z", 304, {"ETag": '"x"'})
    (tmp_path / "one.warc").write_bytes(record + revisit)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(revisit[:-30]))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path))
    assert sorted(r["record_id"] for r in rows.collect()) == ["<u:1>", "<u:1>", "<u:2>"]
    done = warc.resolve_revisits(rows).filter("record_type = 'revisit'").collect()
    assert [bytes(r["payload"]) for r in done] == [b"body\r\n\r\nmore"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    answer = con.execute(SQL[name])
    names = [c[0] for c in answer.description]
    want = sorted(map(repr, answer.fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, sf_dir).select(*names).collect()) == want


def test_every_operator_has_a_query():
    assert {re.match(r"op(\d+)_", q)[1] for q in QUERIES} == {str(i) for i in range(1, 11)}


def test_held_out_accuracy(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows) and len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_pipeline(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    item, base = prose(30), prose(120)
    texts = {
        0: prose(80), 1: None, 2: "123 456", 3: base, 4: base.replace(" ", "  ", 3), 5: base + " end", 6: f"{prose(20)} {item} {prose(20)}", 7: prose(3), 8: prose(4000), 9: "",
    }
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", len(t or ""), "x") for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long, ids string")
    import tempfile

    folder = tempfile.mkdtemp()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    left = [{0, 3, 4, 5, 6, 7, 8}, {0, 3, 5, 6, 7, 8}, {0, 3, 6, 7, 8}, {0, 3, 7, 8}, {0, 3, 7, 8}]
    for (_, stage), want in zip(corpus_pipeline.STAGES, left, strict=True):
        docs = stage(spark, docs, folder)
        assert {r["doc_id"] for r in docs.collect()} == want
        assert docs.columns[:5] == corpus_pipeline.COLUMNS
    assert docs.columns == [*corpus_pipeline.COLUMNS, "n_tokens", "ids"] and all(len(r["ids"]) == r["n_tokens"] for r in docs.collect())
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run


def test_pipeline_with_null_and_repeated_keys(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    item, one, two, three = prose(30), prose(90), prose(90), prose(60)
    texts = [
        (None, one), (7, one + " end"), (7, two), (9, two + "  end"), (None, two.replace(" ", "  ", 1)), (None, three), (None, three), (None, f"{prose(9)} {item}"), (7, f"{prose(9)} {item}"), (5, prose(50)), (5, prose(50)),
    ]
    docs = spark.createDataFrame([(k, t, None, "s", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.union(docs.filter("doc_id = 5")).withColumn("lang", docs["source"])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        left.append(sorted((r["doc_id"] or 0, texts.index((r["doc_id"], r["text"]))) for r in docs.collect()))
    everything = sorted([(k or 0, texts.index((k, t))) for k, t in texts] + [(5, 9), (5, 10)])
    exact = [x for x in everything if x[1] != 4]  # its text is that of row 2
    near = [x for x in exact if x[1] not in (0, 3)]
    assert left == [everything, exact, near, *[[x for x in near if x[1] not in (7, 8)]] * 2]


def test_pipeline_of_the_table(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() < spark.read.parquet(f"{sf_dir}/documents.parquet").count()

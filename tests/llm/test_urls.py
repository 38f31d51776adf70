"""URL verdicts on hand-made cases; the filter never loses a listed URL."""

import numpy as np

from panelrisk.llm.urls import MAX_BLOCKS, MIN_BLOCKS, _masks, bloom_filter, filter_blocks, judge_urls


def test_verdicts(spark):
    urls = [
        (1, "http://Blog.Example.ORG/es/1?x=1"),
        (2, "https://example.org/en/1"),
        (3, "https://a.b.example.org/en/12#f"),
        (4, "https://org/"),
        (5, "https://org"),
        (6, "http://x.com/fr/a"),
        (7, "http://x.com/de/a"),
        (8, "http://notorg/"),
        (9, None),
        (10, "no scheme"),
        (11, "http://www.Bad.net/page/?q=1"),
        (12, "https://bad.net/page#x"),
        (13, "https://bad.net/page2"),
        (13, "https://bad.net/page2"),
        (None, "ftp://m.bad.net/page//"),
        (14, "http:///nohost"),
    ]
    pages = spark.createDataFrame([(i, u, "k", "n") for i, u in urls], "page_id long, url string, key string, name string")
    listed = spark.createDataFrame([("http://bad.net/page",), ("http://bad.net/page/",), (None,), ("nothing",)], "url string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, listed).collect()), key=str)
    want = [
        (1, "blog.example.org", "/es/1", "example.org/es/", "block"),
        (2, "example.org", "/en/1", "example.org/en/1", "block"),
        (3, "a.b.example.org", "/en/12", "example.org/en/1", "block"),
        (4, "org", "/", "org/", "allow"),
        (5, "org", "", None, "allow"),
        (6, "x.com", "/fr/a", "com/fr/", "allow"),
        (7, "x.com", "/de/a", "com/de/", "block"),
        (8, "notorg", "/", None, "allow"),
        (9, "", "", None, "allow"),
        (10, "", "", None, "allow"),
        (11, "www.bad.net", "/page/", None, "block"),
        (12, "bad.net", "/page", None, "block"),
        (13, "bad.net", "/page2", None, "allow"),
        (13, "bad.net", "/page2", None, "allow"),
        (None, "m.bad.net", "/page//", None, "block"),
        (14, "", "/nohost", None, "allow"),
    ]
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.net/b")], "page_id long, url string")
    assert judge_urls(none, some).count() == 0
    assert [r.verdict for r in judge_urls(some, none).collect()] == ["allow"]


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    listed = spark.range(20000).selectExpr("concat('h', id, '.net/p') as canonical")
    words = bloom_filter(listed, blocks=1 << 10)
    h = np.array([r[0] for r in listed.selectExpr("xxhash64(canonical)").collect()], np.int64)
    block, mask = _masks(h, 1 << 10, 6)
    assert ((words[block] & mask) == mask).all()
    block, mask = _masks(h ^ np.int64(0x5555555555555555), 1 << 10, 6)
    assert ((words[block] & mask) == mask).all(axis=1).mean() < 0.05


def test_filter_grows_with_the_list_up_to_its_bound():
    sizes = [filter_blocks(n) for n in (0, 1, 30_000, 40_000, 1_000_000, 10**7, 10**8, 10**11)]
    assert sizes == sorted(sizes) and sizes[0] == MIN_BLOCKS and sizes[-1] == MAX_BLOCKS
    for n, blocks in ((40_000, sizes[3]), (1_000_000, sizes[4])):
        assert 16 * n <= 512 * blocks < 32 * n


def test_verdicts_do_not_depend_on_the_filter(spark):
    """A filter of one block, full of false positives, leaves the same verdicts."""
    pages = spark.range(3000).selectExpr("id as page_id", "if(id % 7 = 0, null, concat('http://h', id % 900, '.net/p')) as url")
    listed = spark.range(400).selectExpr("concat('https://www.h', id * 2, '.net/p/') as url")
    few, many = judge_urls(pages, listed, blocks=1), judge_urls(pages, listed)
    plain = lambda df: sorted((r.page_id, r.verdict, r.listed) for r in df.collect())
    want = sorted((i, "block" if hit else "allow", hit) for i in range(3000) for hit in [i % 7 != 0 and i % 900 < 800 and i % 900 % 2 == 0])
    assert plain(few) == plain(many) == want
    assert few.where("possible_hit").count() > many.where("possible_hit").count() >= many.where("listed").count()
    assert many.where("possible_hit and host = ''").count() == 0

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import entries, hash_ring, url_tree


def test_every_row_has_a_slot_and_counts_differ_by_one(spark, odd_docs, no_docs):
    rows = hash_ring.assign(odd_docs, 4).collect()
    assert sorted(((r.id, r.size, r.text_crc32) for r in rows), key=str) == sorted(((r.doc_id, len(t := (r.text or "").encode()) + 1, zlib.crc32(t)) for r in odd_docs.collect()), key=str)
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert hash_ring.assign(no_docs).count() == 0


def test_query_over_a_table(spark):
    rows = entries.op10_hash_ring(spark, "/root/testdata/sf0.01").toPandas()
    sizes = rows.groupby("shard").size()
    assert len(rows) == 1000 and set(sizes) == {125} and set(rows["law"]) == {"rows"}
    assert (rows.groupby("shard")["slot"].max() == 124).all() and rows.groupby("shard")["slot"].nunique().eq(125).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=64, max_size=64), st.integers(1, 7))
def test_walk_places_all_rows_within_bounds(counts, shards):
    counts = np.array(counts)
    room = hash_ring.bounds(int(counts.sum()), shards)
    runs = hash_ring.walk(counts, hash_ring.ring(shards, 5, 64), room)
    took, at = np.zeros(shards, int), np.zeros(64, int)
    for cell, first, shard, n in runs:
        assert first == at[cell]
        at[cell] += n
        took[shard] += n
    assert (at == counts).all() and (took <= room).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=32, max_size=32), st.integers(1, 6))
def test_walk_equals_rows_that_walk_one_by_one(counts, shards):
    """Turn by turn every row asks where it stands; who finds no room goes on to the next cell of a shard that has some."""
    owner, room = hash_ring.ring(shards, 4, 32), hash_ring.bounds(sum(counts), shards)
    got = {(cell, k): s for cell, first, s, n in hash_ring.walk(np.array(counts), owner, room) for k in range(first, first + n)}
    left, placed = room.copy(), {}
    rows = [(c, k, c) for c, n in enumerate(counts) for k in range(n)]
    while rows:
        rest = []
        for home, k, at in rows:
            s = owner[at]
            if left[s]:
                left[s] -= 1
                placed[home, k] = int(s)
            else:
                rest.append((home, k, at))
        rows = []
        for home, k, at in rest:
            while not left[owner[at]]:
                at = (at + 1) % 32
            rows.append((home, k, at))
    assert got == placed


def test_rows_of_one_id_are_parted(spark):
    """A third of the rows share an id, some have none, and some are the same: each has its slot, cells are ranked in parts."""
    rows = [(7, f"text {k}") for k in range(300)] + [(None, None)] * 200 + [(k, "x") for k in range(400)] + [(5, "same")] * 100
    out = hash_ring.assign(spark.createDataFrame(rows, "doc_id long, text string"), 3).toPandas()
    assert len(out) == 1000 and sorted(out.groupby("shard").size()) == [333, 333, 334]
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])


def test_rows_stay_where_the_ring_puts_them_while_there_is_room():
    r = np.random.default_rng(0)
    counts, owner = r.poisson(50, hash_ring.CELLS), hash_ring.ring(8)
    free = hash_ring.walk(counts, owner, np.full(8, counts.sum()))
    assert all(shard == owner[cell] for cell, _, shard, _ in free)


def test_slack_limits_movement_when_a_shard_is_added():
    r = np.random.default_rng(0)
    counts = r.poisson(50, hash_ring.CELLS)

    def shards_of(n, slack):
        out = {}
        for cell, first, s, k in hash_ring.walk(counts, hash_ring.ring(n), hash_ring.bounds(int(counts.sum()), n, slack)):
            for x in range(first, first + k):
                out[cell, x] = s
        return out

    moved = {}
    for slack in (0.0, 0.25):
        before, after = shards_of(8, slack), shards_of(9, slack)
        moved[slack] = np.mean([before[k] != after[k] for k in before])
    assert moved[0.25] < moved[0.0] < 0.15


def test_hosts_paths_and_rules(spark):
    rows = [(1, None), (2, "abc"), (3, "HTTP://A.Net"), (4, "x://B.EXAMPLE.net/en/1?x#y"), (5, "x://example.net/en"), (6, "http://foo.org/fr/a/b/c/d/e#z"), (7, "http://É.org?x/y"), (8, "a://b://c/d"), (9, "s://xexample.com/de/1"), (10, "s://a.example.com/de/1"), (11, "s://h.net#/x"), (None, "s://example.org/fr/")]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_tree.judge(spark.createDataFrame(rows, "page_id long, url string"), entries.RULES).collect()}
    assert out[1] == out[2] == ("", "", None, "allow")
    assert out[3] == ("a.net", "", None, "allow")
    assert out[4] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert out[5] == ("example.net", "/en", "net/", "block")
    assert out[6][:3] == ("foo.org", "/fr/a/b/c/d/e", "org/fr/")
    assert out[7][:3] == ("É.org", "", None)
    assert out[8][:2] == ("b:", "//c/d")
    assert out[9][2] is None
    assert out[10][2:] == ("example.com/de/", "block")
    assert out[11][:3] == ("h.net", "", None)
    assert out[None][2:] == ("org/fr/", "allow")


def test_templates_are_rejected_by_labelled_purity(spark):
    rows = [(k, f"http://h.test/{'good' if k % 2 else 'bad'}/item-{k}/{k}.html") for k in range(400)]
    rows += [(1000 + k, f"http://one.test/slug{chr(97 + k % 26)}{chr(97 + k // 26)}/") for k in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad, good = url_tree.F.col("path").startswith("/bad/") & (url_tree.F.length("path") > 18), url_tree.F.col("path").startswith("/good/")
    out = {r.page_id: r for r in url_tree.judge(pages, [], bad, good).collect()}
    assert all(out[k].verdict == ("allow" if k % 2 else "block") for k in range(400))
    assert all(out[1000 + k].verdict == "allow" and out[1000 + k].bad_share == 0.5 for k in range(100))
    assert url_tree.judge(pages.limit(0), entries.RULES).count() == 0


def test_like_branches_merge_and_unlike_do_not():
    root = url_tree._Node()
    for name, n, bad in (("a", 200, 190), ("b", 180, 172), ("c", 150, 2)):
        node = root.children[name] = url_tree._Node()
        node.n, node.bad, node.good, node.ends = n, bad, n - bad, n
        root.n += n
    assert {frozenset(v) for v in url_tree._merged(root).values()} == {frozenset("ab"), frozenset("c")}


@pytest.mark.parametrize("languages", [12, 13, 40, 300])
def test_more_segments_do_not_change_a_verdict(spark, languages):
    """Frequent or differently labelled segments stay apart; rare ones still share what is known of their place."""
    names = ["de", *[f"{chr(97 + k // 26)}{chr(97 + k % 26)}q" for k in range(languages - 1)]]
    rows = [(i * 1000 + k, f"http://a.example.com/{name}/{k}") for i, name in enumerate(names) for k in range(40)]
    rows += [(10**6 + k, f"http://b.test/{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}/x") for k in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = url_tree.F.col("path").startswith("/de/") | (url_tree.F.col("host").eqNullSafe("b.test") & (url_tree.F.crc32("path") % 3 == 0))
    out = {r.page_id: r for r in url_tree.judge(pages, [], bad, url_tree.F.lit(False)).collect()}
    assert all(out[i * 1000 + k].verdict == ("allow" if i else "block") for i in range(languages) for k in range(40))
    assert all(out[10**6 + k].verdict == "block" for k in range(2000))


def slow_shares(pages):
    """bad_share of each page (host, typed path, bad, good), by the method's definition over lists of pages, host by host."""
    scale = math.sqrt(0.5 * math.log(2 / 0.05))

    def split(rows, depth):
        out = defaultdict(list)
        for r in rows:
            if len(r["segs"]) > depth:
                out[r["segs"][depth]].append(r)
        return out

    def generalise(rows, depth):
        kids, inner = split(rows, depth), [r for r in rows if len(r["segs"]) > depth]
        if len(kids) > 12:
            for kid in kids.values():
                rest = len(inner) - len(kid)
                if len(kid) >= 0.01 * len(inner):
                    continue
                bound = scale * (1 / math.sqrt(len(kid)) + 1 / math.sqrt(rest))
                bad, good = (sum(r[c] for r in kid) / len(kid) - (sum(r[c] for r in inner) - sum(r[c] for r in kid)) / rest for c in ("bad", "good"))
                name = "*bad" if bad > bound or good < -bound else "*good" if good > bound or bad < -bound else "*"
                for r in kid:
                    r["segs"][depth] = name
        for kid in split(rows, depth).values():
            generalise(kid, depth + 1)

    def alike(a, b, depth):
        bound = scale * (1 / math.sqrt(len(a)) + 1 / math.sqrt(len(b)))
        ka, kb = split(a, depth), split(b, depth)
        shares = [[sum(r[c] for r in x) / len(x) for x in (a, b)] for c in ("bad", "good")]
        shares += [[sum(len(r["segs"]) == depth for r in x) / len(x) for x in (a, b)]]
        shares += [[len(k.get(s, [])) / len(x) for k, x in ((ka, a), (kb, b))] for s in {*ka, *kb}]
        return all(abs(x - y) <= bound for x, y in shares) and all(alike(ka[s], kb[s], depth + 1) for s in {*ka} & {*kb})

    def judge(rows, depth):
        purity = (sum(r["bad"] for r in rows) + 2) / (sum(r["bad"] + r["good"] for r in rows) + 4)
        for r in rows:
            if len(r["segs"]) == depth:
                r["share"] = purity
        classes = []
        for _, kid in sorted(split(rows, depth).items(), key=lambda kv: (-len(kv[1]), kv[0])):
            into = next((c for c in classes if alike(c, kid, depth + 1)), None)
            classes.append(list(kid)) if into is None else into.extend(kid)
        for c in classes:
            judge(c, depth + 1)

    rows = [{"host": h, "segs": t.split("/"), "bad": b, "good": g} for h, t, b, g in pages]
    hosts = defaultdict(list)
    for r in rows:
        hosts[r["host"]].append(r)
    for mine in hosts.values():
        generalise(mine, 0)
        judge(mine, 0)
    return [r["share"] for r in rows]


def test_trees_equal_a_slow_version(spark):
    r = random.Random(11)
    rows, words = [], [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    for h, n in (("a.test", 900), ("b.test", 400), ("c.test", 60), ("d.test", 1)):
        for _ in range(n):
            first = r.choice(words[: 4 if h == "c.test" else 25] + ["spam"] * 6)
            path = "/".join([first, *[r.choice(["x", "y", str(r.randrange(99)), f"s{r.choice(words)}{r.choice(words)}"]) for _ in range(r.randrange(4))]])
            noise = r.random() < (0.98 if first == "spam" else 0.2 if first < "d" else 0.02)
            rows.append((len(rows), f"http://{h}/{path}{r.choice(['', '/', '.html'])}", r.choice(["a", "b"]) if noise else "c", noise))
    pages = spark.createDataFrame(rows, "page_id long, url string, kind string, noise boolean")
    html = url_tree.F.when(url_tree.F.col("noise"), "<article>%% $$ ##</article>").otherwise("<article>plain words of a page</article>")
    out = {x.page_id: x for x in url_tree.judge(pages.withColumn("html", html), []).collect()}
    shares = slow_shares([(out[k].host, out[k].typed_path, int(row[3]), int(not row[3])) for k, row in enumerate(rows)])
    assert [out[k].bad_share for k in range(len(rows))] == pytest.approx(shares)
    for host in ("a.test", "b.test"):  # unruled pages of one host get either verdict
        assert {out[k].verdict for k in range(len(rows)) if out[k].host == host} == {"allow", "block"}
    assert all((out[k].verdict == "block") == (shares[k] >= url_tree.REJECT) for k in range(len(rows)))


def test_content_labels(spark):
    texts = {
        "prose": ("<html><head><title>%%%</title></head><body><article class='x'><h1>A title</h1><p>Plain words &amp; more, of a page that goes on for a while, as prose does.</p></article></body>", False),
        "symbols": ("<article>the%% of$$ and## to** it</article>", True),
        "capitals": ("<article>BUY NOW AND SAVE</article>", True),
        "exclaimed": ("<article>wow! this! is! great</article>", True),
        "repeated": ("<article>" + "one two " * 20 + "</article>", True),
        "no article": ("<html><head><script>$$$$</script></head><body>plain words here</body></html>", False),
        "empty": ("<article> \n </article>", None),
        "null": (None, None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in texts.items()], "name string, html string")
    got = {x.name: x.n for x in url_tree.with_noise(df, "html", "n").collect()}
    assert got == {k: v[1] for k, v in texts.items()}


def test_odd_pages(spark):
    """Nulls, repeated ids, a very long URL, columns that the operator uses itself, and no content at all."""
    rows = [(1, "http://a.test/" + "x/" * 50_000, "x", 1, None), (1, None, None, 1, None), (None, "http://a.test/b", "y", None, "<p>"), (None, "http://a.test/b", "y", None, "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, n int, html string")
    for df in (pages, pages.drop("html")):
        out = url_tree.judge(df, entries.RULES).collect()
        assert len(out) == 4 and all(x.bad_share == 0.5 and x.verdict == "allow" for x in out)
        assert sorted(len(x.path) for x in out) == [0, 2, 2, 100_001]


def test_the_plan_of_the_levels_stays_small(spark):
    counts = spark.createDataFrame([("a.test", f"x/{k}/y", 3, 1, 2) for k in range(20)], "host string, typed string, n long, bad long, good long")
    out = url_tree._generalised(counts)
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 3
    assert {r.typed: r.n for r in out.collect()} == {f"x/{k}/y": 3 for k in range(20)}

"""Near duplicates, mixing, packing, sharding, extraction, the classifier."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import _spark, _text, cotraining, dedup, html_extract, mixing, packing, sharding
from tests.llm.data import ROWS, documents, edge, empty, words

# near duplicates


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """(doc_id, n_shingles, component_id) by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


def test_groups_equal_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect()]
    found = dedup.op2_minhash_dedup(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.fixture(scope="module")
def chains(spark):
    """Chains of edited copies: neighbours are similar, the ends are not."""
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 40, 200, 400]))]
        for _ in range(25):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(max(1, len(text) // 70)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(5000)}"
    rows += [(len(rows), rows[3][1].upper()), (len(rows) + 1, rows[3][1].replace(" ", "\n\t"))]
    return rows


@pytest.mark.parametrize("blocks, hot", [((512, 1 << 20), 512), ((7, 500), 4)])
def test_chains_equal_all_pairs(spark, chains, blocks, hot, monkeypatch):
    monkeypatch.setattr(_spark, "HOT_ROWS", hot)
    monkeypatch.setattr(dedup, "STAR", hot)
    docs = spark.createDataFrame(chains, "doc_id long, text string").repartition(5)
    found = dedup.near_duplicates(docs, block_docs=blocks[0], block_shingles=blocks[1]).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(chains)


def test_dedup_edges(spark):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in dedup.near_duplicates(edge(spark)).collect()}
    assert {(1, 10, 1, True), (6, 10, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (7, 1, 7, True)} <= found
    assert dedup.near_duplicates(empty(spark)).count() == 0
    kept = dedup.dedup_stage(spark, edge(spark), "")
    assert kept.columns == edge(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10]


def test_common_counts_equal_set_intersections(monkeypatch):
    monkeypatch.setattr(dedup, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(n)] for n in (9, 5))
    assert dedup.common(left, right).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert dedup.common(left, [np.array([99], dtype=np.uint64)]).sum() == 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    one, two = ("the first text has these few words", 4), ("another one is not like it at all", 4)
    rows = [(5, *one), (7, *one), (7, *two), (7, two[0].upper(), 9), (7, *two), (8, two[0].replace(" ", "\n"), 4), (9, None, 1), (9, "", 1), (9, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    found = dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in found) == [(5, 5, True), (7, 5, False)] + [(7, 7, True)] * 3 + [(8, 7, False)] + [(9, 9, True)] * 3
    kept = sorted((r["doc_id"], (r["text"] or "").lower()) for r in dedup.dedup_stage(spark, docs, "").collect())
    assert kept == [(5, one[0]), (7, two[0]), (9, "")]


def test_links_of_every_fiftieth_document_are_found(spark):
    sf_dir = "/root/testdata/sf0.01"
    sets = {r["doc_id"]: shingles(r["text"]) for r in documents(spark, sf_dir).collect()}
    found = {r["doc_id"]: r["component_id"] for r in dedup.op2_minhash_dedup(spark, sf_dir).collect()}
    links = [(i, j) for i in sets if i % 50 == 0 and sets[i] for j in sets if i != j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert links and all(found[i] == found[j] for i, j in links)


def test_components_of_any_shape(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FOREST", 20)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    up = {x: x for e in edges for x in e}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    found = {r["node"]: r["root"] for r in dedup.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert {x: found.get(x, x) for x in up} == {x: root(x) for x in up}


# mixing


def brute_targets(sizes):
    """Water filling by repetition, in fractions."""
    weight = [1 + k % 3 for k in range(len(sizes))]
    got, free = [Fraction(0)] * len(sizes), {k for k, s in enumerate(sizes) if s}
    while free:
        left = sum(sizes) - sum(got[k] for k in range(len(sizes)) if k not in free)
        share = {k: Fraction(left * weight[k], sum(weight[j] for j in free)) for k in free}
        over = {k for k in free if share[k] > 3 * sizes[k]}
        if not over:
            for k in free:
                got[k] = share[k]
            break
        for k in over:
            got[k] = Fraction(3 * sizes[k])
        free -= over
    return got


@pytest.mark.parametrize("sizes", [[100, 10, 1], [1, 1, 1000], [0, 5, 0, 700], [3], [0], [50, 1, 50, 1, 50, 2, 900]])
def test_targets_equal_repeated_filling(sizes):
    got = mixing.targets(sizes, [1 + k % 3 for k in range(len(sizes))], sum(sizes))
    assert [Fraction(*x) for x in got] == brute_targets(sizes)


def test_seats_equal_one_by_one():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        weights, caps = [rng.randint(1, 50) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)]
        seats, won = rng.randint(0, 200), [0] * n
        for _ in range(min(seats, sum(caps))):
            won[min((i for i in range(n) if won[i] < caps[i]), key=lambda i: (-Fraction(weights[i], 2 * won[i] + 1), i))] += 1
        assert mixing.sainte_lague(weights, caps, seats) == won


def test_mix_takes_what_it_should(spark, sf_dir):
    found = mixing.op3_mixing(spark, sf_dir).toPandas()
    source = {r["doc_id"]: r["source"] for r in documents(spark, sf_dir).collect()}
    text = {r["doc_id"]: r["text"] for r in documents(spark, sf_dir).collect()}
    assert len(found) == len(source) and (found.taken <= 3 * found["size"]).all() and (found.taken >= 0).all()
    assert all(n == len(words(text[i])) for i, n in zip(found.doc_id, found["size"], strict=True))
    own = found.groupby(found.doc_id.map(source), dropna=False).agg(size=("size", "sum"), given=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    own = own.loc[sorted(own.index, key=lambda s: (s is None or s != s, s if isinstance(s, str) else ""))]
    assert (own["size"] == own.given).all()
    assert np.allclose(own.target, [float(x) for x in brute_targets(own["size"].tolist())])
    assert ((own.taken - own.target).abs() <= 2 * mixing.BLOCK).all()
    again = mixing.op3_mixing(spark, sf_dir).toPandas().sort_values("doc_id", ignore_index=True)
    assert again.equals(found.sort_values("doc_id", ignore_index=True))


def test_mix_edges_and_shards(spark, sf_dir):
    docs = edge(spark).withColumn("size", F.lit(40))
    found = mixing.mix(docs).collect()
    assert len(found) == 11 and all(0 <= r["taken"] <= 120 for r in found)
    assert mixing.mix(empty(spark).withColumn("size", F.lit(1))).count() == 0
    zero = mixing.mix(docs.withColumn("size", F.lit(0))).collect()
    assert {(r["target"], r["taken"]) for r in zero} == {(0.0, 0)}
    sized = documents(spark, sf_dir).select("doc_id", "source", F.length("text").alias("size"))
    many = mixing.mix(sized, shard_words=5000).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.first("source_size").alias("s")).collect()
    assert all(abs(r["t"] - r["n"]) <= mixing.BLOCK * (2 + r["s"] // 5000) for r in many)
    few = mixing.mix(sized, shard_words=50, most_shards=4).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert all(abs(r["t"] - r["n"]) <= mixing.BLOCK * 8 for r in few)
    staged = mixing.mix_stage(spark, edge(spark), "")
    assert staged.columns == edge(spark).columns


# packing


def check_packing(rows, texts, room=1024):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes()) and 0 < r["length"] <= room
            at += r["length"]
        assert at == len(ids) and all(r["length"] == room for r in own[1:]) and (len(own) == 1 or len(ids) > room)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= room
    return len(sequences)


def test_packing_is_whole_and_tight(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, sf_dir).collect()}
    rows = packing.op4_best_fit_packing(spark, sf_dir).collect()
    used = check_packing(rows, texts)
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_packing_edges(spark):
    rows = packing.pack(edge(spark)).collect()
    one = [r for r in rows if r["doc_id"] == 7]
    assert len(one) == 2 and {r["length"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    check_packing(rows, {i: t for i, t, *_ in ROWS if i not in (None, 7)})
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    low, high = rng.choice([(1, 1024), (300, 700), (400, 560), (1, 60), (1024, 1024), (340, 345)])
    histogram = Counter(rng.randint(low, high) for _ in range(rng.choice([1, 30, 3000])))
    slots, made = packing.plan(histogram)
    placed, rooms = Counter(), defaultdict(list)
    for length, first, number, at in slots:
        placed[length] += number
        for s in range(first, first + number):
            rooms[s].append((at, length))
    assert placed == histogram and len(rooms) == made
    for s in rooms.values():
        s.sort()
        assert [a for a, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1]) and sum(n for _, n in s) <= 1024
    plain = packing.Rooms(1024)
    for n in sorted(histogram, reverse=True):
        plain.best_fit(n, histogram[n])
    assert -(-sum(n * c for n, c in histogram.items()) // 1024) <= made <= plain.made


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_grouped_plan_needs_no_more_than_best_fit_decreasing(spark, sf):
    rows = packing.op4_best_fit_packing(spark, f"/root/testdata/{sf}").collect()
    plain = packing.Rooms(1024)
    for n, c in sorted(Counter(r["length"] for r in rows).items(), reverse=True):
        plain.best_fit(n, c)
    assert len({r["sequence_id"] for r in rows}) <= plain.made


def test_large_lengths_stand_in_groups_of_like_number():
    histogram = {n: 10 for n in range(400, 500)} | {5: 7}
    sizes, demand = packing.grouped(histogram, 342, 20)
    assert demand.sum() == 1000 and len(sizes) == 20 and set(demand) == {50.0} and sizes[0] == 499


# sharding


def test_shards_follow_the_key_law(spark, sf_dir):
    rows = sharding.op5_sharding(spark, sf_dir).collect()
    text = {r["doc_id"]: r["text"] for r in documents(spark, sf_dir).collect()}
    slots = defaultdict(list)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(text) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_move_only_their_subtree(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    leaf = lambda s, w=1.0: sharding.Node(f"s{s}", w, (), s)
    rack = lambda k, *c: sharding.Node(f"rack{k}", children=c)
    tree = lambda w: sharding.Node("root", children=(rack(0, leaf(0), leaf(1)), rack(1, leaf(2), leaf(3, w))))
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.assign(ids, tree(w)).collect()} for w in (1.0, 2.0))
    assert all(abs(sum(x == s for x in a.values()) - 1000) < 150 for s in range(4))
    moved = {(a[i], b[i]) for i in a if a[i] != b[i]}
    assert moved and {to for _, to in moved} <= {2, 3} and all(x in (0, 1) or to == 3 for x, to in moved)


def test_sharding_edges(spark):
    rows = sharding.shard_documents(edge(spark)).collect()
    assert len(rows) == 11 and {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1
    assert sharding.shard_documents(empty(spark)).count() == 0
    many = spark.range(50_000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"))  # one key, far over a slice
    got = sharding.shard_documents(many).agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("m")).first()
    assert (got["n"], got["m"]) == (50_000, 49_999)


# extraction

PAGE = """<html><head><title>T</title><style>x</style></head><body><nav>Menu</nav><div class="cookie-notice">We use</div>
<article><h1>Head &amp; more</h1><p>First  <b>bo</b>ld\ntext.<p>Second<br>line<div class="ad">Buy</div><ul><li>one<li>two</ul></article>
<aside>Side</aside><div id="comments"><p>Nice!</p></div><footer>Foot</footer><script>var a;</script></body></html>"""


def test_article_is_left():
    assert html_extract.extract(PAGE) == "Head & more\n\nFirst bold text.\n\nSecond line\n\none\n\ntwo"
    assert html_extract.extract(None) == html_extract.extract("") == ""
    assert html_extract.extract("plain &lt;text&gt;") == "plain <text>"
    assert html_extract.extract("<p>" + "<div>" * 3000 + "deep") == "deep"


def test_names_alone_dont_empty_an_article():
    page = "<article><p>Kept one.</p><div class='related-work'>Related</div><section id='alert'>Alert</section><h2 class='share'>Share</h2><fieldset><legend>Legend</legend>Set</fieldset></article>"
    assert html_extract.extract(page) == "Kept one.\n\nRelated\n\nAlert\n\nShare\n\nLegend\n\nSet"
    page = "<body><div class='widget'>" + "<p>many words of the page</p>" * 20 + "</div><div class='advert'>Buy this</div></body>"
    assert html_extract.extract(page) == "\n\n".join(["many words of the page"] * 20)


@pytest.mark.parametrize("part", ["<a href='x ", '<a "', "<a '\">\"", "<", "<div ", "<! ", "<![CDATA[ ", "<ul><li>", "</p><i>", "<p><span>", "<b>x</i>"])
def test_a_megabyte_of_broken_tags_takes_seconds(part):
    started = time.monotonic()
    html_extract.extract(part * (1_000_000 // len(part)))
    assert time.monotonic() - started < 30


def test_tags_end_where_a_slow_reading_ends():
    """Each '<' with a name is a tag if a '>' outside of quotes follows; all texts between are kept."""
    rng = random.Random(8)
    for _ in range(400):
        source = "".join(rng.choice(["<a ", ">", '"', "'", "x", "</a", "<", " b="]) for _ in range(rng.randrange(40)))
        want, at = [], 0
        while at < len(source):
            if m := re.match(r"</?[a-zA-Z][^\s/>]*", source[at:]):
                k, quote = at + m.end(), ""
                while k < len(source) and (quote or source[k] != ">"):
                    if not quote and source[k] in "\"'":
                        quote = source[k]
                    elif source[k] == quote:
                        quote = ""
                    k += 1
                if k < len(source):
                    at = k + 1
                    want.append(" ")
                    continue
            want.append(source[at])
            at += 1
        assert html_extract.text_of(html_extract.parse(source)).replace(" ", "") == "".join("".join(want).split()), source


def slow_tree(pages):
    """(path, pages, importance) of one host's pages, from lists of what each page shows."""
    shown = defaultdict(lambda: ([], []))
    for source in pages:
        own = defaultdict(lambda: ([], []))

        def walk(node, above, own=own):
            for c in node.children:
                if isinstance(c, str):
                    continue
                path = html_extract.path_of(c, above)
                if c.tag not in ("script", "style", "meta", "link", "title", "html", "body", "head"):
                    own[path][0].append(html_extract.style_of(c))
                    own[path][1].append(html_extract.text_of(c))
                walk(c, path)

        walk(html_extract.parse(source), "")
        for path, (styles, contents) in own.items():
            shown[path][0].append(tuple(styles))
            shown[path][1].append(tuple(contents))
    out = []
    for path, kinds in shown.items():
        n = len(kinds[0])
        entropy = [-sum(c / n * math.log(c / n) for c in Counter(k).values()) / math.log(n) if n > 1 else 1.0 for k in kinds]
        own = 0.9 ** len(set(kinds[0]))
        out.append((path, n, (n * ((1 - own) * entropy[0] + own * entropy[1]) + 1) / (n + 1)))
    return sorted(out)


def test_the_style_tree_equals_a_slow_one(spark):
    rng = random.Random(3)

    def page():
        inner = "".join(rng.choice(["<p>one</p>", "<div class='x'>two<b>three</b></div>", "<ul><li>a<li>b</ul>", f"<p>{rng.randrange(9)}</p>"]) for _ in range(rng.randrange(5)))
        return f"<html><body><div class='top'>Same</div>{inner}</body></html>"

    pages = [page() for _ in range(30)]
    found = html_extract.style_trees(spark.createDataFrame([("h", p) for p in pages], "host string, html string")).collect()
    want = slow_tree(pages)
    assert sorted((r["path"], r["pages"]) for r in found) == [(p, n) for p, n, _ in want]
    assert np.allclose([r["importance"] for r in sorted(found, key=lambda r: r["path"])], [x for _, _, x in want])
    assert dict((p, x) for p, _, x in want)["/html/body/div.top"] < html_extract.BAR


def test_a_host_with_many_pages_meets_its_list_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "HOST_PAGES", 5)
    frame = lambda i: f"<html><body><div class='frame'>Same on all pages</div><p>Own text {i}</p></body></html>"
    rows = [(i, f"https://h.org/{i}", frame(i)) for i in range(40)] + [(50 + i, f"https://k.org/{i}", frame(i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own text {i}" for i in range(40)} | {50 + i: f"Own text {i}" for i in range(6)}


def test_branches_that_never_change_go(spark):
    frame = lambda i: f"<html><body><div class='frame'><span>Same on all pages</span></div><div class='x'><p>Own text {i} of page {i * 7}</p></div></body></html>"
    pages = spark.createDataFrame([(i, f"https://h.org/{i}", frame(i)) for i in range(12)] + [(99, "https://other.org/", frame(5)), (100, None, frame(1)), (101, "u", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    assert got[3] == "Own text 3 of page 21" and got[99].startswith("Same on all pages") and got[101] == "" and len(got) == 15
    weights = {r["path"]: r["importance"] for r in html_extract.style_trees(pages.select(F.lit("h").alias("host"), "html")).collect()}
    assert weights["/html/body/div.frame"] < html_extract.BAR < weights["/html/body/div.x"]


def test_branches_that_never_change_go_from_named_articles(spark):
    page = lambda i: f"<html><body><div class='wrap'><article><p>Own text {i}<img src='{i}'>tail</p><div class='zone'><p>Read this on every page</p></div><p>More {i * 7}</p></article></div></body></html>"
    same = "<html><body><main><p>All pages of this host say this</p></main></body></html>"
    rows = [(i, f"https://h.org/{i}", page(i)) for i in range(12)] + [(100 + i, f"https://same.org/{i}", same) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3tail\n\nMore 21"
    assert got[104] == "All pages of this host say this"


def test_deep_branches_are_judged(spark):
    long = "c" * 60
    page = lambda i: "<html><body><div id='root'>" + "<div>" * 90 + f"<div class='{long}a'>Same here</div><div class='{long}b'>Own {i}</div><p>Text {i * 7}</p>"
    pages = spark.createDataFrame([(i, f"https://h.org/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}[3] == "Own 3\n\nText 21"
    tree = html_extract.parse("<div>a<b>b</b> c<i>a b</i><script>x</script></div><p>a b c</p><p>a<i>b c</i></p>" + "<div>" * 5000 + "deep")
    found = html_extract.branches(tree)
    assert len(found) == 5007 and max(len(p) for p, _, _ in found) <= html_extract.LONGEST
    for _, x, hx in found[:8]:
        for _, y, hy in found[:8]:
            assert (hx == hy) == (html_extract.text_of(x) == html_extract.text_of(y))


def test_pages_of_the_table(spark, sf_dir):
    rows = html_extract.op8_html_extraction(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and "<" not in r["text"][:1] for r in rows)
    assert sum(r["n_chars"] > 100 for r in rows) > 0.8 * len(rows)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
    clash = html_extract.extract_pages(pages.withColumn("host", F.lit(1)).withColumn("low", F.lit(2)).withColumn("text", F.lit(3)))
    assert clash.columns == ["page_id", "url", "text", "n_chars"] and clash.count() == len(rows)


# quality classifier


def test_classifier_tells_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = cotraining.op10_quality_classifier(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.9
    assert found.count() == documents(spark, sf_dir).count()


def slow_views(r):
    """A document's two views, word by word."""
    text, out = r["text"] or "", {}
    own = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words(text)]
    hashes = [int(_text.token_hashes(np.array([ord(c) for c in w], dtype=np.uint32), np.array([0]))[0]) for w in own]
    for h in hashes:
        out[h % cotraining.WORDS] = out.get(h % cotraining.WORDS, 0) + 1
    norm = math.sqrt(sum(out.values())) or 1
    n, joined = max(1, len(own)), "".join(own)
    solid = len(joined)
    letters = sum("a" <= c <= "z" or ord(c) > 127 for c in joined)
    digits = sum("0" <= c <= "9" for c in joined)
    symbols = sum(ord(c) < 128 for c in joined) - digits - sum("a" <= c <= "z" for c in joined)
    pairs = len(set(zip(own, own[1:]))) if len(own) > 1 else 1
    shape = [1, math.log1p(len(own)) / 8, solid / n / 8, letters / max(1, solid), digits / max(1, solid), symbols / max(1, solid), sum("A" <= c <= "Z" for c in text) / n, len(set(own)) / n, pairs / max(1, n - 1), text.count("\n") / n, len(own) < 50, symbols > 0.1 * solid]
    out = {k: math.sqrt(c) / norm for k, c in out.items()}
    return out | {cotraining.WORDS + k: float(x) for k, x in enumerate(shape)}, cotraining.meta_view(r["source"], r["lang"], r["n_chars"])[0]


def test_scores_equal_a_slow_twin(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = cotraining.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = {r["doc_id"]: r["score"] for r in cotraining.score(docs, model).collect()}
    for r in docs.collect():
        text, meta = slow_views(r)
        zt = model.text.scale * sum(model.text.weights[k] * x for k, x in text.items()) + model.text.shift
        zm = model.meta.scale * sum(model.meta.weights[k] for k in meta) + model.meta.shift
        want = 1 / (1 + math.exp(-(model.mix[0] * zt + model.mix[1] * zm + model.mix[2]))) if words(r["text"]) else 0.0
        assert abs(found[r["doc_id"]] - want) < 1e-6


def test_rounds_take_the_surest_of_all_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rng = np.random.default_rng(1)
    weights = [rng.normal(0, 3, cotraining.WORDS + cotraining.SHAPES), rng.normal(0, 1, cotraining.META)]
    known = [set(range(0, 50)), set(range(100, 120))]
    rows = cotraining._with_views(docs).repartition(5).mapInArrow(cotraining._views, cotraining._SAMPLE)
    found = rows.mapInArrow(cotraining._surest_of(weights, known, 12, 5), "view int, label int, z double, tie long, " + cotraining._SAMPLE).collect()
    z = {r["doc_id"]: [sum(weights[0][k] * x for k, x in text.items()), sum(weights[1][k] for k in meta)] for r in docs.collect() for text, meta in [slow_views(r)]}
    for v in (0, 1):
        for y, most in ((1, 12), (0, 5)):
            sign = 1 if y else -1
            want = sorted((i for i in z if i not in known[v] and sign * z[i][v] > 1), key=lambda i: (-sign * z[i][v], i))[:most]
            got = [r["doc_id"] for r in sorted((r for r in found if (r["view"], r["label"]) == (v, y)), key=lambda r: (r["z"], r["doc_id"]))][:most]
            assert [round(z[i][v], 3) for i in got] == [round(z[i][v], 3) for i in want]


def test_classifier_edges(spark):
    docs = edge(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (9, None), (None, 1), (6, 1), (7, 0), (10, 1)], "doc_id long, quality int")
    model = cotraining.learn(docs, labels)
    rows = cotraining.score(docs, model).collect()
    assert len(rows) == 11 and {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0.0}
    assert cotraining.learn(docs, labels.limit(0)) is None
    assert {r["score"] for r in cotraining.score(docs, None).where("doc_id = 1").collect()} == {1.0}
    assert cotraining.score(empty(spark), None).count() == 0
    bare = cotraining.score(docs.select("doc_id", "text"), model).count()
    assert bare == 11

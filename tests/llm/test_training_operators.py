"""Every operator against brute force on small tables with the awkward rows."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import bpe, catalog, components, jaccard, license, lm, packing, quality, tokenfile, topk, toxicity, urlfilter
from quire.llm.pieces import tokenizer
from quire.llm.shared import Workspace

WORD = r"[^\x20\x09-\x0D]+"


def corpus(seed: int = 3, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    words = [a + b for a in ("ba", "ko", "li", "tu", "zé", "Qa") for b in ("", "n", "r", "st", "mo", "ß", "x,")]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(i, text(rng.choice([1, 3, 12, 60, 200])), f"h{i % 4}") for i in range(n)]
    for i in range(n, n + 40):  # near copies of a few
        own = rows[i % 5 + 10][1].split()
        own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(own), "h1"))
    rows += [(900 + i, rows[20][1], "hot") for i in range(30)]
    rows += [(1000, None, "h1"), (1001, "", None), (1002, " \n\t ", "h2"), (1003, "one", "h2"), (1004, "long " * 6000, "h2"), (1005, "same line\nsame line\n" * 20, "h3"), (None, "no id " * 20, "h3"), (None, None, None)]
    rows += [rows[30], rows[30]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    return made.selectExpr("*", "1 as n", "'x' as score", "0 as part", "'y' as cls", "5 as length", "1 as _text").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_packing(docs, empty):
    for capacity in (64, 2048):
        got = packing.best_fit_pack(docs, capacity=capacity).collect()
        t = tokenizer("byte_bpe_50k.json")
        want = Counter()
        for doc, text, *_ in corpus():
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
            begin, piece, lead = 0, 0, len(ids) % capacity or capacity
            while begin < len(ids):
                stop = lead if piece == 0 else begin + capacity
                want[doc, piece, begin, stop - begin, zlib.crc32(np.array(ids[begin:stop], "<u4").tobytes())] += 1
                begin, piece = stop, piece + 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        spans = defaultdict(list)
        for r in got:
            spans[r.sequence_id].append((r.offset, r.length))
        for s in spans.values():
            s.sort()
            assert all(o == sum(n for _, n in s[:k]) for k, (o, _) in enumerate(s))
            assert sum(n for _, n in s) <= capacity
        least = -(-sum(r.length for r in got) // capacity)
        assert len(spans) <= least * 1.05 + 2
    assert packing.best_fit_pack(empty).count() == 0


def test_packing_many_rounds_of_small_pieces(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "cast(1 + id % 7 as long) as length", "id as ids_crc32")
    got = packing.pack(rows, capacity=50, ranges=6).groupBy("sequence_id").agg({"length": "sum"}).count()
    assert got <= math.ceil(sum(1 + i % 7 for i in range(3000)) / 50) + 3
    with pytest.raises(ValueError):
        packing.pack(rows.selectExpr("doc_id", "piece", "start", "99L as length", "ids_crc32"), capacity=50)


def brute_lm(rows, order=3):
    tokens = lambda t: [*[w.lower() for w in re.findall(WORD.encode(), (t or "").encode())], None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    grams = lambda t, k: list(zip(*[(["<s>"] * (k - 1) + t)[i:] for i in range(k)], strict=False))
    train = [tokens(t) for d, t in rows if not held(d)]
    uni = Counter(w for t in train for w in t)
    counts = {order: Counter(g for t in train for g in grams(t, order))}
    for k in range(order - 1, 0, -1):  # how many grams end with one
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    context, follow, cut = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter)), {}
    for k, own in counts.items():
        cut[k] = lm.discounts(*[sum(1 for c in own.values() if c == n) for n in (1, 2, 3, 4)])
        for g, c in own.items():
            context[k][g[:-1]] += c
            follow[k][g[:-1]][min(c, 3)] += 1
    n, v = sum(uni.values()), len(uni)

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else None
        c, total = counts[k][g], context[k][g[:-1]]
        if not total:
            return below if k > 1 else 1 / (v + 1)
        g_ = sum(cut[k][i] * follow[k][g[:-1]][i] for i in (1, 2, 3)) / total
        return max(c - cut[k][min(c, 3)], 0) / total + g_ * (below if k > 1 else 1 / (v + 1))

    for start in (("<s>",) * (order - 1), (("<s>",) * order + next((tuple(t) for t in train if len(t) > 20), ()))[-order:-1]):
        assert not train or abs(sum(p((*start, w)) for w in uni) + p((*start, "unseen")) - 1) < 1e-9
    out = []
    for d, t in rows:
        own = tokens(t)
        score = sum(math.log10(p(g)) for g in grams(own, order))
        out.append((d, held(d), len(own), sum(w in uni for w in own), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in own), score))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(docs, empty, order):
    got = lm.perplexity(docs, order=order).collect()
    want = brute_lm([(d, t) for d, t, _ in corpus()], order)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for r, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(r[:5]) == w[:5]
        assert r.base_score == pytest.approx(w[5], rel=1e-9) and r.score == pytest.approx(w[6], rel=1e-9)
    if order == 3:
        assert lm.perplexity(empty).count() == 0


def test_a_model_of_nothing_knows_no_word(spark, docs):
    keep = Workspace(spark)
    marked = lm.held_out(docs)
    for r in lm.score(marked, lm.fit(marked.limit(0), keep)).collect():
        assert r.n_known == 0 and r.train_tokens == 0 and r.score == 0.0 and r.base_score == 0.0


def test_a_very_long_word_in_every_operator(spark):
    from tests.llm.test_kernel import thue_morse

    a, b = thue_morse(21)
    rows = [(1, a, "h"), (2, b, "h"), (3, f"{a} {b} x", "h"), (4, f"{b} {a} x", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, 1, 85).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    got = {r.doc_id: r for r in lm.perplexity(docs).collect()}
    assert [got[i].n_tokens for i in (1, 2, 3, 4)] == [2, 2, 4, 4]
    short = [(i, t, "h") for i, t in ((1, a[: 1 << 12]), (2, b[: 1 << 12]))]
    t = tokenizer("byte_bpe_50k.json")
    for r in bpe.round_trip(spark.createDataFrame(short, "doc_id long, text string, source string")).collect():
        text = short[r.doc_id - 1][1]
        assert r.text == text and np.frombuffer(r.ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def brute_quality(text):
    words = re.findall(WORD, text or "")
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality(docs, empty):
    got = quality.judge(docs).collect()
    want = Counter((d, *brute_quality(t)) for d, t, _ in corpus())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in got)
    assert quality.judge(empty).count() == 0


def test_a_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good if i % 10 == 0 else "too short", "bad") for i in range(200)] + [(1000 + i, good, f"h{i % 9}") for i in range(300)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.kept for r in got if r.doc_id < 200} == {False}
    assert {r.kept for r in got if r.doc_id >= 1000} == {True}


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in re.findall(WORD.encode(), (t or "").encode())]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_near_duplicates(docs, empty, k, percent):
    got = jaccard.near_duplicates(docs, k, percent).collect()
    assert Counter(map(tuple, got)) == brute_components([(d, t) for d, t, _ in corpus()], k, percent)
    kept = jaccard.keep_one(docs, k, percent)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.doc_id == r.component_id} | {None}
    assert jaccard.near_duplicates(empty).count() == 0


def test_near_copies_that_no_pivot_links(spark):
    """A chain of edits: each text links with the next alone."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[(7 * i) % 60] = f"e{i}"
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 85).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, 2, 85)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(500, 501 + i) for i in range(50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark)).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


def test_url_filters(spark):
    urls = ["http://a.example.com/en/1", "https://WWW.Example.com/en/x?q#f", "http://example.com", "http://x.net/fr/", "http://notexample.com/en/", "ftp://net/es/a#b", "http://net/es", "no scheme", None, "", "http://?x", "http://a.b.net/es/" + "y" * 5000, "http://com/", "x://deep.a.b.c.d.example.com/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, html string")
    got = urlfilter.judge(pages, urlfilter.rule_table(spark, catalog.URL_RULES)).collect()
    for r in got:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in catalog.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    assert len(got) == len(urls) + 1
    none = urlfilter.judge(pages, spark.createDataFrame([], "verdict string, host string, path string"))
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark, catalog.URL_RULES)).count() == 0


def brute_top(rows, k, every):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = defaultdict(list)
    for i, v in whole:
        if i % every == 0:
            queries[i].append(v)
    out = Counter()
    for q, own in queries.items():
        near = []
        for i, b in whole:
            scores = [sum(x * y for x, y in zip(a, b, strict=True)) for a in own if len(a) == len(b)]
            if i != q and scores:
                near.append((-max(scores), i))
        out.update((q, r, i, -s) for r, (s, i) in enumerate(sorted(near)[:k], 1))
    return out


def test_top_k(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 8))
    rows = [(i, (centre[i % 4] * (1 + i % 5) + 0.2 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)] + [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 8), (2060, [0.0] * 8), (2080, [1.0, 2.0]), (2081, [3.0, -1.0]), (None, rows[0][1]), (2100, []), (2120, [1e30] * 3), (2121, [-1e30] * 3)]
    rows += [rows[20], rows[20], rows[11], rows[11], (40, rows[60][1]), (41, rows[61][1])]  # repeated, equal and not
    frame = spark.createDataFrame([(*r, 1, "q", 2) for r in rows], "vec_id long, embedding array<double>, rank int, query_id string, score int").repartition(4)
    want = Counter({x: n for x, n in brute_top(rows, 20, 20).items() if x[0] != 2120})
    for options in ({"bucket": 64, "block": 16}, {"bucket": 64, "steep": 0.0}, {"steep": 2.0}):
        got = Counter(tuple(r) for r in topk.top_k(frame, **options).collect())
        assert Counter({x: n for x, n in got.items() if x[0] != 2120}) == want
        assert got[2120, 1, 2121, -(2**63)] == 1
    assert topk.top_k(frame.limit(0)).count() == 0


def test_repeated_rows_are_one_query(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (11, [0.5, 1.0]), (10, [0.25, 0.0]), (10, [0.25, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).collect()
    assert sorted(map(tuple, got)) == [(20, 1, 11, 2048), (20, 2, 10, 1024), (20, 3, 10, 1024)]


def test_queries_meet_buckets_without_copies(spark, monkeypatch):
    """Blocks copied for every partition were broadcast: their planned size was that of one copy."""
    plans = []

    class Noted(topk.Workspace):
        def save(self, df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().save(df, name)

    monkeypatch.setattr(topk, "Workspace", Noted)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(700)] + [(i, rng.normal(size=2).tolist()) for i in range(700, 730)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, block in ((2, 1), (40, 16)):  # tasks with all buckets, and with a slice of them
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out = topk.top_k(frame, k=7, every=10, bucket=32, block=block)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            assert Counter(map(tuple, out.collect())) == brute_top(rows, 7, 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plans and not any(x in p for p in plans for x in ("Broadcast", "Join", "CartesianProduct"))


def test_least_scores_come_last():
    assert topk._best(np.array([-(2**63), 0, -5]), np.arange(3), 2).tolist() == [1, 2]
    fold = topk.Fold(1)
    fold.add(np.array([[20, 21, 0, 1, -(2**63)], [20, 22, 0, 1, 0]]))
    fold.settle()
    assert fold.out().column(1).to_pylist() == [22]


def test_the_fold_of_a_task_keeps_what_counts():
    rng = np.random.default_rng(1)
    rows = np.column_stack([rng.integers(0, 5, 3000), rng.integers(0, 200, 3000), rng.integers(0, 2, 3000), np.ones(3000, np.int64), rng.integers(0, 90, 3000)]).astype(np.int64)
    fold, out = topk.Fold(7, most=40), []
    for i in range(0, 3000, 13):
        if full := fold.add(rows[i : i + 13]):
            out.append(full)
    fold.settle()
    got = np.concatenate([np.column_stack([c.to_numpy() for c in b.columns]) for b in [*out, fold.out()]])

    def top(some):
        best = {}
        for q, v, w, _, x in some.tolist():
            best[q, v, w] = max(best.get((q, v, w), -1), x)
        return {q: sorted((-x, v, w) for (p, v, w), x in best.items() if p == q)[:7] for q in range(5)}

    assert len(got) < 3000 and top(got) == top(rows)


def test_token_files(spark, docs, empty, tmp_path):
    folder = tokenfile.write(docs, f"file://{tmp_path}/ids", frame_ids=500, files=3)
    got = tokenfile.read(spark, folder).collect()
    t, start = tokenizer("word_bpe_49k.json"), 0
    rows = corpus()
    want = {}
    for d, text, _ in rows:
        want.setdefault(d, []).append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in want[r.doc_id] and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        start += len(ids)
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in rows)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    assert {k: v.tolist() for k, v in tokenfile.lookup(folder, [5, 1004, 77777]).items()} == {5: want[5][0], 1004: want[1004][0]}
    name = tokenfile.manifest(folder)["files"][0]["file"]
    body = bytearray((tmp_path / "ids" / name).read_bytes())
    body[40] ^= 255
    (tmp_path / "ids" / name).write_bytes(body)
    with pytest.raises(Exception):  # noqa: B017
        [tokenfile.Reader(f"{folder}/{name}").frame(k) for k in range(1)]
    assert tokenfile.read(spark, tokenfile.write(empty, f"file://{tmp_path}/none")).count() == 0


def test_byte_pairs(docs, empty):
    got = bpe.round_trip(docs).collect()
    t = tokenizer("byte_bpe_50k.json")
    want = Counter()
    for d, text, _ in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[d, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.text) for r in got) == want
    assert bpe.round_trip(empty).count() == 0


def test_a_table_of_other_texts_still_encodes(spark, docs):
    keep = Workspace(spark)
    table = bpe.build_word_table(spark.createDataFrame([("a few words",)], "text string"), keep)
    other = bpe.decode(bpe.encode(docs, table)).collect()
    assert Counter((r.doc_id, r.text) for r in other) == Counter((d, t or "") for d, t, _ in corpus())


def test_digests(spark, docs, tmp_path):
    docs.select("doc_id", "text").where("doc_id < 5").write.parquet(f"{tmp_path}/documents.parquet")
    for r in catalog.op8_bpe_round_trip(spark, str(tmp_path)).collect():
        text = next(t for d, t, _ in corpus() if d == r.doc_id)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_toxicity(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice("abdeiou") for _ in range(6)) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["grumblex", "grumbleton", "idiot", "1d1ot"])
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "idiot " * 9), rows[0]]
    labels += [(0, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, known).collect()
    assert len(got) == len(rows)
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in unseen) / len(unseen)
    assert right > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
    clean = toxicity.keep_clean(docs.selectExpr("*", "1 as _text", "'b' as toxicity"), known)
    assert clean.columns == ["doc_id", "text", "_text", "toxicity"]
    assert clean.count() == sum(r.predicted == 0 for r in got)
    assert {r.score for r in toxicity.score(docs, known.limit(0)).collect()} == {0.0}
    assert toxicity.score(empty, known).count() == 0


@pytest.mark.parametrize("n", [60, 400, 4000])
def test_scores_are_calibrated_at_every_size(spark, n):
    rng = random.Random(n)
    text = lambda toxic: " ".join(rng.choice(["grumble", "idiot", "you"] if toxic and rng.random() < 0.3 else ["calm", "river", "stone", "green", "walk"]) for _ in range(20))
    rows = [(i, text(i % 3 == 0)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int"))
    assert model.knots is not None and (np.diff(model.knots[1]) > 0).all()
    again = toxicity.fit(docs.repartition(7), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int"))
    assert again.lexicon == model.lexicon and (again.knots[1] == model.knots[1]).all()


def brute_features(lexicon, text):
    """The dense features of one text, from their descriptions."""
    words = re.findall(WORD, text)
    low = [toxicity.forms(w) for w in words]
    best = lambda x: max((lexicon.get(e, 0.0) for e in toxicity.entries(x)), default=0.0)
    weight = [max(best(a), best(b)) for a, b in low]
    hits = [i for i, w in enumerate(weight) if w > 1]
    you = [i for i, (a, _) in enumerate(low) if a in toxicity.YOU]
    near = sum(any(abs(i - j) <= 5 for j in you) for i in hits)
    n, size, letters = max(len(words), 1), max(len(text.encode()), 1), max(sum(c.isascii() and c.isalpha() for c in text), 1)
    return [
        sum(weight[i] for i in hits) / n, max(weight, default=0), len(hits) / n, math.log1p(len(hits)), math.log1p(sum(w > 2 for w in weight)),
        sum(b in toxicity.SEED for _, b in low) / n, near / n, math.log1p(near), sum(c.isascii() and c.isupper() for c in text) / letters,
        sum(len(w) > 2 and w.isupper() for w in words) / n, text.count("!") / size, text.count("?") / size, sum(a != b for a, b in low) / n,
        sum(best(b) > best(a) for a, b in low if a != b) / n, sum(bool(re.search(r"(\w)\1\1", a)) for a, _ in low) / n, math.log1p(len(words)),
    ]


def test_features_are_those_of_a_brute_force_count():
    import pyarrow as pa
    from quire.llm import kernel

    lexicon = dict.fromkeys(toxicity.SEED, 2.0) | {"grumb+": 1.5, "river": 2.5, "weak": 0.5}
    rng = random.Random(6)
    words = ["you", "YOU,", "idiot", "1d1ot!", "id10t", "GRUMBLES", "grumbler?", "river", "weak", "soooo", "b@d", "\u00e9t\u00e9", "dich", "a", "!!", "s.t.u.p.i.d", "\u00a0x", "stone\u2003wall"]
    texts = ["", " \n", *[rng.choice(["", " "]) + rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(80)]]
    got = toxicity.features(toxicity.Words(lexicon), *kernel.strings(pa.array(texts)))
    assert np.allclose(got, [brute_features(lexicon, t) for t in texts])


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = toxicity.fit_trees(x, y)
    assert ((model.margin(x) > 0) == y).mean() > 0.9
    knots = toxicity.isotonic(model.margin(x), y)
    assert (np.diff(knots[1]) > 0).all() and (np.diff(knots[0]) > 0).all()


def test_licenses(spark, docs):
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 3.0."), (3, "Licensed under the Apache License, Version 2.0."), (4, None), (5, ""), (6, "we need a permission slip"), (7, "This work is licensed under the GNU General Public License, version 3. And so on."), (None, "All rights reserved."), (8, license.TEMPLATES[2][1].replace("modify, ", ""))]
    rows.append((9, "x " * 5000 + ". Licensed under CC BY-NC 4.0. " + "y " * 5000))
    got = {(r.doc_id, r.license, r.exact): r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT", True), (3, "Apache-2.0", True), (7, "GPL-3.0", True), (None, "Proprietary", True), (8, "MIT", False), (9, "CC-BY-NC-4.0", True)}
    texts = dict(rows)
    for (d, name, _), r in got.items():
        assert texts[d][r.start : r.start + r.length].strip()
        assert r.reduction > 0.2 and (d != 8 or r.words_missing == 1)
    assert license.scan(docs).count() == 0


def found(spark, *texts):
    """Of each text the licenses found in it."""
    got = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [Counter((r.license, r.exact) for r in got if r.doc_id == i) for i in range(len(texts))]


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""


def test_licenses_in_long_blocks(spark):
    got = found(
        spark, BSD, "Copyright 2021 by the authors, the editors, all translators and the readers, Licensed under CC BY 4.0.",
        "Licensed under CC BY 4.0.\nAll rights reserved.", "ALL RIGHTS RESERVED.", "Copyright notes. " * 300 + "Released under the MIT License.",
    )
    assert got == [{("BSD-3-Clause", True): 1}, {("CC-BY-4.0", True): 1}, {("CC-BY-4.0", True): 1, ("Proprietary", True): 1}, {("Proprietary", True): 1}, {("MIT", True): 1}]


def test_all_licenses_of_a_block(spark):
    got = found(
        spark, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "\n".join(x for _, x in license.TEMPLATES),
        "Released under the MIT License.\nLicensed under the new Apache License, Version 2.0.", "This work is licensed under the GNU Lesser General Public License, version 3.",
    )
    assert got[0] == {(x, True): 1 for x in ("Apache-2.0", "MIT", "CC-BY-NC-4.0")}
    assert got[1] == {(x, True): 1 for x, _ in license.TEMPLATES}, "one row a license"
    assert got[2] == {("MIT", True): 1, ("Apache-2.0", False): 1}
    assert got[3] == {("LGPL-3.0", True): 1}


GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so."""


def test_wrapped_licenses(spark):
    narrow = lambda text, width: "\n".join(" * " + x for x in textwrap.wrap(text, width))
    long = [(name, x) for name, x in license.TEMPLATES if len(x) > 140]
    texts = [GPL, MIT, "\n".join("# " + x for x in GPL.split("\n")), *[narrow(x, w) for _, x in long for w in (16, 40, 72)]]
    got = found(spark, *texts)
    assert got[:3] == [{("GPL-3.0", True): 1}, {("MIT", True): 1}, {("GPL-3.0", True): 1}]
    assert got[3:] == [{(name, True): 1} for name, _ in long for _ in range(3)]
    rows = license.scan(spark.createDataFrame([(0, "intro\n\n" + GPL)], "doc_id long, text string")).collect()
    assert [("intro\n\n" + GPL)[r.start : r.start + r.length].split()[-1] for r in rows] == ["version"]


BSD2 = BSD[: BSD.index("3. Neither")].strip()


def test_licenses_that_share_clauses(spark):
    narrow = "\n".join("# " + x for x in textwrap.wrap(BSD.replace("\n", " "), 60))
    seven = [x for name in ("MIT", "Apache-2.0", "CC-BY-4.0", "BSD-2-Clause", "CC0-1.0", "GPL-3.0", "Proprietary") for x in [next(t for n, t in license.TEMPLATES if n == name)]]
    clause = "In the year of the great flood the editors, the printers and all the readers of this small paper agreed on one thing that still holds everywhere and was "
    got = found(spark, BSD2, BSD, narrow, BSD.replace("specific prior", "prior"), BSD2.split("\n")[0], "\n".join(seven), clause + "Released under the MIT License.", "x\n# SPDX-License-Identifier: BSD-2-Clause\n")
    assert got[0] == {("BSD-2-Clause", True): 1}
    assert got[1] == got[2] == {("BSD-3-Clause", True): 1}
    assert got[3] == {("BSD-3-Clause", False): 1}
    assert got[4] == {("BSD", True): 1}
    assert set(got[5]) == {(x, True) for x in ("MIT", "Apache-2.0", "CC-BY-4.0", "BSD-2-Clause", "CC0-1.0", "GPL-3.0", "Proprietary")}
    assert got[6] == {("MIT", True): 1}
    assert got[7] == {("BSD-2-Clause", True): 1}
    assert license.scan(spark.createDataFrame([], "doc_id long, text string, license string")).count() == 0


def test_places_are_those_of_a_brute_force_scan():
    """Every template against every window of the words, by plain edit distance."""
    rng = random.Random(8)
    scanner = license.Scanner(license.TEMPLATES)
    short = [k for k, own in enumerate(scanner.words) if len(own) < 25]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            own = list(scanner.words[rng.choice(short)])
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(["new", "license", "the", "by"])
            words += [rng.choice("abcde") for _ in range(rng.randrange(4))] + own
        for k in short:
            want, must = scanner.words[k], scanner.must[k]
            room, least = max(1, 0.1 * len(want)), None
            for i in range(len(words)):
                row = list(range(len(want) + 1))
                for j in range(i, min(len(words), i + len(want) + 3)):
                    new = [row[0] + 1]
                    for n, w in enumerate(want, 1):
                        new.append(min(new[-1] + 1, row[n] + 1, row[n - 1] if w == words[j] else 99))
                    row = new
                    if row[-1] <= room and not must - set(words[i : j + 1]):
                        least = min(row[-1], 99 if least is None else least)
            got = scanner.places(tuple(words), k)
            assert (got[0][0] if got else None) == least, (words, want)


def test_templates_are_ranked_by_compression(spark):
    scanner = license.Scanner(license.TEMPLATES)
    for k, (name, text) in enumerate(license.TEMPLATES):
        words = tuple(license._words(text))
        ranked = scanner.ranked(words)
        assert sorted(ranked) == list(range(len(license.TEMPLATES)))
        size = [scanner.sizes(words, i)[1] for i in ranked]
        assert size == sorted(size) and license.TEMPLATES[ranked[0]][0] == name
    texts = [license.TEMPLATES[0][1], "\n".join(x for _, x in license.TEMPLATES)]
    rows = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.license, r.rank) for r in rows if r.doc_id == 0] == [("MIT", 1)]
    every = [r for r in rows if r.doc_id == 1]
    assert {r.license for r in every} == {x for x, _ in license.TEMPLATES} and max(r.rank for r in every) > 6, "low ranks are confirmed too"
    assert all(0 < r.reduction < 1 for r in rows)


def test_labels_of_other_documents_take_no_places(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 3000, 50)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    own = [i for i in range(0, 3000, 50) if zlib.crc32(str(i).encode()) % 3 != 1]
    for most, want in ((30, 30), (1000, len(own))):
        got = toxicity.labelled(docs, known, 1, 3, most).collect()
        assert len(got) == want and {int(r.text.split()[1]) for r in got} <= set(own)

"""The numbered queries against SQL or brute force on the smallest tables, and every operator on odd rows."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegraph.llm import decontamination, exact_dedup, lm_scoring, near_dedup, packing, pii, quality, queries, substring_dedup, toxicity, url_filter
from framegraph.llm.common import in_fold

from ..compare import connect, same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, block int, rep string, component int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 977}" for k in range(30_000))


def rows(*texts, first=0):
    """Rows with nulls in other columns and names that operators use inside."""
    return [(first + k, t, None, None, None, "x", None, None, "y", None) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    data = rows("", None, "one", LONG, LONG, "Same Text here and there", "same text HERE and there", " \n\t ", "é ñ 漢字 😀 a@b.de", "x" * 40_000, "a b c d e f")
    data += data[2:3] + [(None, "no id", "en", None, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, n=None):
    got = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    return {i: t for i, t in got}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


# op1 -------------------------------------------------------------------------------------------------------------


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    t.encode_special_tokens = True
    return t


def check_packing(out, texts, capacity):
    t, pieces, total = tokenizer(), collections.Counter(), 0
    for doc, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity)]
        for k, s in enumerate(cuts):
            part = ids[s : min(s + capacity if k else (len(ids) - 1) % capacity + 1, len(ids))]
            pieces[doc, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        total += len(ids)
    assert pieces == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    held = collections.defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), math.ceil(total / capacity)


def test_packing(spark):
    used, least = check_packing(queries.QUERIES["op1_best_fit_packing"](spark, SF).collect(), documents(spark).items(), 2048)
    assert used <= least + 1


def test_packing_odd_rows(spark, odd, none):
    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    check_packing(packing.pack(odd, path, 64).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], 64)
    assert packing.pack(none, path).count() == 0


def test_same_ids_as_the_library():
    import public_tokenizers

    rng, texts = np.random.default_rng(1), ["<|endoftext|> don't", "a\u00a0\n b", "é²³½ ٣ x", "漢字 😀", "\r\n  \n", "a" * 5000]
    texts += ["".join(rng.choice(list("ab é \n\t.'s1\u00a0"), 30)) for _ in range(2000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert packing._Tokens(public_tokenizers.path(packing.TOKENIZER)).ids(texts) == want


def fewest(sizes, capacity):
    """Fewest bins, by search."""
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rng = np.random.default_rng(2)
    for _ in range(150):
        capacity = int(rng.integers(8, 30))
        items = sorted(rng.integers(1, capacity + 1, rng.integers(1, 10)).tolist(), reverse=True)
        left = packing._Sizes(dict(collections.Counter(items)))
        fixed = packing.reduce_by_dominance(left, capacity)
        rest = [s for s, n in left.n.items() for _ in range(n)]
        assert all(sum(f) <= capacity for f, _ in fixed)
        assert sum(n for _, n in fixed) + fewest(sorted(rest, reverse=True), capacity) == fewest(items, capacity), items


# op2, op10 ---------------------------------------------------------------------------------------------------------


def test_toxicity_finds_labelled_documents(spark):
    out = {r["doc_id"]: r for r in queries.QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    hit = sum(out[r["doc_id"]]["toxic"] == bool(r["toxic"]) for r in labels)
    assert hit / len(labels) > 0.95
    assert all(0 <= r["severity"] <= 3 for r in out.values())


def test_toxicity_on_unseen_documents(spark):
    """Learned from half of the labels, held against the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = in_fold(F.col("doc_id"), 2, 0)
    out = toxicity.severity(docs.where(~half), toxicity.fit(docs, labels.where(half)))
    rows = out.join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").select(F.col("toxic").cast("int"), "y").collect()
    both = sum(a and b for a, b in rows)
    assert both / sum(b for _, b in rows) > 0.8 and both / sum(a for a, _ in rows) > 0.85


def test_toxicity_thresholds_rise(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    theta = toxicity.fit(docs, labels).theta
    assert (np.diff(theta) > 0).all()


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 1, 0), (3, 1, 1), (None, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.severity(odd, model).count() == odd.count()
    assert toxicity.severity(none, toxicity.fit(none, labels.limit(0))).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == odd.count()


def test_quality_on_unseen_documents(spark):
    out = queries.QUERIES["op10_quality"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_quality_gradients():
    """Analytic against numeric derivatives."""
    rng = np.random.default_rng(0)
    w = {k: a.astype(np.float64) for k, a in quality.initial().items()}
    texts, y = [bytes(rng.integers(32, 120, n).tolist()) for n in (700, 30, 1500)], np.array([1.0, 0.0, 1.0])
    data, owner = quality.chunks(texts)

    loss = lambda: quality.loss(w, data, owner, y)
    g = quality._gradients(w, data, owner, y, np.ones(3))
    for name in w:
        at = tuple(rng.integers(0, n) for n in w[name].shape) if name != "E" else (int(data[0, 5]), 2)
        keep, step = w[name][at], 1e-5
        w[name][at] = keep + step
        up = loss()
        w[name][at] = keep - step
        down = loss()
        w[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4), name


def test_quality_covers_the_whole_text():
    text = bytes(range(32, 127)) * 40
    data, owner = quality.chunks([text, b"", b"x" * quality.CHUNK])
    assert len(data) == len(owner) and (owner == 1).sum() == 1 and (owner == 2).sum() == 1
    mine = data[owner == 0]
    assert b"".join(bytes(c[: quality.HOP]) for c in mine[:-1]) + bytes(mine[-1]).rstrip(b"\0") == text


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    w = quality.train(odd, labels, F.lit(True), steps=5)
    out = quality.score(odd, w).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(none, quality.train(none, labels, F.lit(True))).count() == 0


# op3 -------------------------------------------------------------------------------------------------------------


def test_lm_scoring(spark):
    tokens = {i: [*WHITE.findall(t.translate(LOW)), 0] for i, t in documents(spark).items()}
    c = collections.Counter(x for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in t)
    n, v = sum(c.values()), len(c)
    out = queries.QUERIES["op3_lm_scoring"](spark, SF).collect()
    assert len(out) == len(tokens)
    for r in out:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def vocabulary():
    rng = np.random.default_rng(4)
    known = rng.integers(1, 2**63, 3000).astype(np.uint64)
    known[5] = lm_scoring.END_HASH
    counts = np.sort(rng.integers(1, 500, 3000))[::-1].copy()
    return lm_scoring.Vocabulary(known, counts, int(counts.sum()), 4000, rng.integers(1, 90, lm_scoring.BUCKETS).astype(float), rng.integers(1, 30, lm_scoring.BUCKETS).astype(float))


def test_lm_gradients_and_normalisation():
    v, rng = vocabulary(), np.random.default_rng(5)
    w = {k: a.astype(np.float64) + rng.normal(0, 0.05, a.shape) for k, a in lm_scoring.initial(v).items()}
    inputs, targets = rng.integers(0, v.units, (6, 3)), rng.integers(0, v.units, (6, 3))
    live, h = np.ones((6, 3), bool), np.zeros((3, lm_scoring.HIDDEN))
    live[4:, 1] = False
    g, _, _ = lm_scoring._train_window(w, v, inputs, targets, live, h)
    loss = lambda: -lm_scoring._train_window(w, v, inputs, targets, live, h)[2]
    for name in w:
        at = tuple(rng.integers(0, n) for n in w[name].shape) if name not in ("E", "D", "db") else {"E": (inputs[2, 0], 3), "D": (4, v.place[targets[1, 0]]), "db": (v.place[targets[1, 0]],)}[name]
        keep, step = w[name][at], 1e-4
        w[name][at] = keep + step
        up = loss()
        w[name][at] = keep - step
        down = loss()
        w[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3), name
    # all units together have probability one
    states = np.repeat(rng.normal(0, 0.3, (1, lm_scoring.HIDDEN)), v.units, 0)
    assert np.exp(lm_scoring._outputs(w, v, states, np.arange(v.units))[0]).sum() == pytest.approx(1, abs=1e-4)


def test_lm_state_goes_through_the_whole_document():
    """Scores do not depend on windows or on what else is scored side by side."""
    v, rng = vocabulary(), np.random.default_rng(6)
    w = {k: a + rng.normal(0, 0.05, a.shape).astype(np.float32) for k, a in lm_scoring.initial(v).items()}
    lengths = [1, 200, 37, 90, 5]
    first, units = np.concatenate([[0], np.cumsum(lengths)]), rng.integers(0, v.units, sum(lengths)).astype(np.int32)
    all_ = lm_scoring._unit_scores(w, v, units, first, window=16)
    for k in range(len(lengths)):
        mine = units[first[k] : first[k + 1]]
        alone = lm_scoring._unit_scores(w, v, mine, np.array([0, len(mine)]), window=1000)
        assert np.allclose(all_[first[k] : first[k + 1]], alone, atol=1e-4)


def test_lm_texts_are_scored_many_at_a_time(monkeypatch):
    """A long text sets how many steps a pool takes: 2.4 million units of long and short texts go in one pool, not three."""
    from types import SimpleNamespace

    import pyarrow as pa

    v, rng, taken = vocabulary(), np.random.default_rng(7), []
    monkeypatch.setattr(lm_scoring, "_unit_scores", lambda w, v, units, first: taken.append(len(units)) or np.zeros(len(units)))
    counts = np.tile([20_000, *[400] * 50], 60)
    rows = {"row": np.arange(len(counts)), "doc_id": np.arange(len(counts)), "n_tokens": counts, "n_known": counts, "base_sum": np.zeros(len(counts)), "inside_sum": np.zeros(len(counts))}
    units = pa.array([rng.integers(0, v.units, n).astype(np.int16).tobytes() for n in counts], pa.binary())
    table = pa.table({**rows, "units": units})
    run = lm_scoring._scores(SimpleNamespace(value=v), SimpleNamespace(value=lm_scoring._pack(lm_scoring.initial(v))))
    out = list(run(iter(table.to_batches(max_chunksize=500))))
    assert sum(b.num_rows for b in out) == len(counts) and taken == [counts.sum()]


def test_lm_window_with_resting_lanes_equals_lanes_alone():
    """Gradients of lanes side by side, some ending early, some starting anew, are the sums of those of each lane alone."""
    v, rng = vocabulary(), np.random.default_rng(8)
    w = {k: a.astype(np.float64) + rng.normal(0, 0.05, a.shape) for k, a in lm_scoring.initial(v).items()}
    inputs, targets = rng.integers(0, v.units, (9, 4)), rng.integers(0, v.units, (9, 4))
    live, fresh, h = np.ones((9, 4), bool), np.zeros((9, 4), bool), rng.normal(0, 0.3, (4, lm_scoring.HIDDEN))
    live[5:, 1], fresh[0, 0], fresh[4, 2] = False, True, True
    before = h.copy()
    g, last, total = lm_scoring._train_window(w, v, inputs, targets, live, h, fresh)
    alone = [lm_scoring._train_window(w, v, *(x[:, k : k + 1] for x in (inputs, targets, live)), h[k : k + 1], fresh[:, k : k + 1]) for k in range(4)]
    assert (h == before).all() and np.allclose(last, np.concatenate([x[1] for x in alone]), atol=1e-5)
    assert total == pytest.approx(sum(x[2] for x in alone), rel=1e-5)
    for name in g:
        assert np.allclose(g[name], sum(x[0][name] for x in alone), atol=1e-4), name


def test_lm_odd_rows(spark, odd, none):
    out = lm_scoring.score(odd, F.coalesce(F.col("doc_id") != 3, F.lit(True))).collect()
    assert len(out) == odd.count() and all(math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in out)
    assert lm_scoring.score(none, F.lit(True)).count() == 0
    nothing = lm_scoring.score(odd, F.lit(False)).collect()
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 and r["train_tokens"] == 0 for r in nothing)


# op4 -------------------------------------------------------------------------------------------------------------


def test_exact_groups_odd_rows(spark, odd, none):
    out = exact_dedup.exact_groups(odd).collect()
    assert len(out) == odd.count()
    assert sum(r["kept"] for r in out) == odd.select(F.sha2(F.lower(F.coalesce("text", F.lit(""))), 256)).distinct().count()
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in out)


def test_cuckoo_index():
    rng = np.random.default_rng(7)
    index, live = exact_dedup.CuckooIndex(4), {}
    for step in range(20_000):
        digest = exact_dedup.digest_of(str(rng.integers(0, 4000)))
        record = index.find(digest)
        assert (record is not None) == (digest in live)
        if record is not None and rng.random() < 0.6:
            assert index.delete(digest)
            del live[digest]
        elif record is None:
            index.insert([digest, step])
            live[digest] = step
    assert index.size == len(live) and {r[0]: r[1] for r in index.records()} == live and index.resizes > 3
    assert not index.delete(exact_dedup.digest_of("never there"))


def test_changes(spark):
    log = [(1, "insert", 1, "A"), (2, "insert", 2, "a"), (3, "insert", 3, "b"), (4, "delete", 2, "a"), (5, "delete", 3, "B"), (6, "delete", 9, "zz"), (7, "insert", 4, None)]
    out = exact_dedup.apply_changes(spark.createDataFrame(log, "seq long, op string, doc_id long, text string")).collect()
    assert {bytes(r["digest"]): r["doc_ids"] for r in out} == {exact_dedup.digest_of("a"): [1], exact_dedup.digest_of(""): [4]}


# op5 -------------------------------------------------------------------------------------------------------------


def brute_repeats(docs, size):
    seen, out = set(), []
    for doc, text in docs:
        w = WHITE.findall(text or "")
        gone = set()
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            if x in seen:
                gone.update(range(k, k + size))
            seen.add(x)
        out.append((doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substrings_odd_rows(spark, odd, none):
    out = sorted(map(tuple, substring_dedup.without_repeats(odd, 3).collect()), key=str)
    order = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    # the two rows without an id come in an order of their own; they share no window
    assert out == sorted(brute_repeats(order, 3), key=str)
    assert substring_dedup.without_repeats(none).count() == 0


# op6 -------------------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.com/en/1?x#y": ("a.example.com", "/en/1", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "ftp://x.net/es/a": ("x.net", "/es/a", "net/es/", "block"), "http://notnet/es/": ("notnet", "/es/", None, None), "http://b.com": ("b.com", "", None, None),
        "http://b.com?x=/": ("b.com", "", None, None), "nothing": ("", "", None, None), "": ("", "", None, None), "http://x.com/a://b.net/fr/": ("x.com", "/a://b.net/fr/", "com/", "allow"),
        "http://É.com/é": ("É.com", "/é", "com/", "allow"),
    }
    pages = spark.createDataFrame([*enumerate(cases), (None, None), (1, "http://b.com/" + "s/" * 20_000)], "page_id long, url string").withColumn("template", F.lit(1))
    out = {r["page_id"]: r for r in url_filter.judged(pages).where("page_id is not null and length(path) < 1000").collect()}
    for k, (host, path, rule, action) in enumerate(cases.values()):
        assert (out[k]["host"], out[k]["path"], out[k]["rule"]) == (host, path, rule)
        assert out[k]["verdict"] == action if action else out[k]["verdict"] in ("allow", "block")
    assert url_filter.judged(pages).count() == len(cases) + 2
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_url_templates_learn_from_neighbours(spark):
    """On a host whose numbered pages under one branch are blocked, an unlabelled page of the branch is rejected."""
    rules = (("block", "h.org", "/bad/a"), ("allow", "h.org", "/good/"))
    urls = [f"http://h.org/bad/a{k}/{k}" for k in range(40)] + [f"http://h.org/good/{k}.html" for k in range(40)] + ["http://h.org/bad/b7/9", "http://h.org/fine/x.html"]
    out = {r["path"]: r["verdict"] for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert out["/bad/b7/9"] == "block" and out["/fine/x.html"] == "allow"


def test_native_plans_have_no_python(spark):
    for df in (url_filter.op6_url_filter(spark, SF), pii.op7_pii(spark, SF)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# op7 -------------------------------------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [int(x) * (1 + k % 2) for k, x in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii_base_spans(spark, odd, none):
    more = rows("a@b.c.com_x@y.co.", "1.2.3.4567.8.9.10", "1.2.3.4.5.6.7.8", "+1 (2", "é 4111 1111 1111 1111 +49 (0) 30.123456-7)", "00255.1.1.1 256.1.1.1", "9" * 30_000, "1 " * 9000, "++12345678901", "a@b..c a@-.-", "😀 a@b.de 12", first=100)
    docs = odd.unionByName(spark.createDataFrame(more, DOCS)).unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = collections.Counter((i, *((k, m.start(), m.end()) for k in KINDS for m in re.finditer(KINDS[k], t) if valid(k, m[0]))) for i, t in texts)
    out = pii.find(docs).collect()
    assert collections.Counter((r["doc_id"], *map(tuple, r["base"])) for r in out) == want
    for r in out:
        spans = [tuple(s) for s in r["spans"]]
        assert set(map(tuple, r["base"])) <= set(spans)
        added = sorted(s[1:] for s in spans if s not in set(map(tuple, r["base"])))
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:], strict=False))
    assert pii.find(none).count() == 0


def test_pii_adds_what_looks_like_base_spans(spark):
    """A phone number without its plus and a spelled-out address are added; a number that fails Luhn and a hash are not."""
    texts = []
    for k in range(60):
        card = next(c for c in (f"45{k:02}1122{k:02}66778{d}" + str(x) for d in range(10) for x in range(10)) if valid("card", c))
        bad = card[:-1] + str((int(card[-1]) + 1) % 10)
        texts += [f"we called +1 ({200 + k}) 555-{1000 + 7 * k} then", f"from ab.{10 + k}@mail{k % 9}.example.com today", f"paid by {card} here", f"number {bad} here", f"hash {k:02}f0ddae3b09ae356cbefecdd3232fa5489b{k:02}00 end", f"order {k}{20240000 + k} ok"]
    extra = ["ring (415) 555-2671 then", "from xy.42 (at) mail3.example (dot) com today", "number 4242424242424241 here", "1 2" * 20_000, "1-" * 20_000]
    out = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts + extra)), "doc_id long, text string")).collect()}
    got = [[tuple(s) for s in out[len(texts) + k]["spans"]] for k in range(3)]
    assert got == [[("phone", 5, 19)], [("email", 5, 39)], []]
    assert sum(len(out[k]["base"]) for k in range(len(texts))) == 180 == sum(len(out[k]["spans"]) for k in range(len(texts)))


def test_boosting_separates_cells():
    cells = [({"a": a, "b": b}, 50, 48 if a > 1 and b > 0 else 1) for a in range(4) for b in range(2)]
    model = pii.boost(cells, ["a", "b"])
    assert all((model.margin(x) >= model.threshold) == (y > 25) for x, _, y in cells)


# op8 -------------------------------------------------------------------------------------------------------------


def test_contamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "a B c d e F"), (2, None), (3, "..."), (10, "one"), (None, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (10, "one")], "item_id long, text string")
    want = []
    for r in odd.collect():
        w = ALNUM.findall((r["text"] or "").translate(LOW))
        hit, items = set(), set()
        for b in bench.collect():
            x = ALNUM.findall((b["text"] or "").translate(LOW))
            for s in range(max(1, len(x) - 9)) if x else ():
                win = x[s : s + 10]
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit.update(range(k, k + len(win)))
                        items.add(b["item_id"])
        want.append((r["doc_id"], len(w), len(hit)))
    for blocks in (decontamination.BLOCK_WINDOWS, 1):  # in one block, and a window at a time
        out = decontamination.contamination(odd, bench, block_windows=blocks).collect()
        assert sorted(((r["doc_id"], r["n_words"], sum(e - s for s, e in r["spans"])) for r in out), key=str) == sorted(want, key=str)
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(odd, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontamination.drop_contaminated(odd, bench).columns == odd.columns


# op9 -------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = ALNUM.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_classes(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            n = len(x & y)
            if n and n >= 0.8 * (len(x) + len(y) - n):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


def test_near_classes(spark):
    out = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op9_near_dedup"](spark, SF).collect()}
    assert out == brute_classes(documents(spark).items())


def test_near_classes_of_a_group_without_a_centre(spark):
    """Copies of copies: neighbours are linked, ends are not; the leader of a bucket links to few."""
    rng = np.random.default_rng(9)
    words = [f"t{k}" for k in range(200)]
    texts = []
    for k in range(60):
        words[int(rng.integers(0, 200))] = f"n{k}"
        texts.append(" ".join(words))
    order = rng.permutation(60)
    docs = [(int(order[k]), t) for k, t in enumerate(texts)] + [(100 + k, f"one word {k}") for k in range(5)] + [(200, None), (201, ""), (202, "x"), (203, "X")]
    out = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute_classes(docs)


def test_near_odd_rows(spark, odd, none):
    out = near_dedup.near_classes(odd).collect()
    assert len(out) == odd.count()
    kept = near_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert near_dedup.near_classes(none).count() == 0


def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(10)
    ids = rng.integers(1, 2**44, 300).astype(np.uint64)
    x, y = np.zeros(300), np.zeros(300)
    x[:220], y[60:] = rng.integers(1, 5, 220), rng.integers(1, 5, 240)
    both = np.flatnonzero((x > 0) & (y > 0))
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
    m = 8192
    keep = [np.flatnonzero(x), np.flatnonzero(y)]
    sig = near_dedup.prob_min_hash(np.concatenate([ids[k] for k in keep]), np.concatenate([x[keep[0]], y[keep[1]]]), np.repeat([0, 1], [len(k) for k in keep]), 2, m)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.02)


def test_repeats_do_not_change_what_is_banded():
    lines = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(40)]
    texts = [" ".join(lines), " ".join(lines[:20] * 100 + lines)]
    extra = near_dedup.Shingles(near_dedup.pa.array(texts))
    ids = near_dedup.pa.array([0, 1])
    (out,) = near_dedup._sign([near_dedup.pa.record_batch([ids, ids, ids, ids, near_dedup.pa.array(texts)], names=["row", "doc_id", "m1", "m2", "text"])])
    a, b = out.column("bands").to_pylist()
    x, y = (set(extra.ids[extra.first[k] : extra.first[k + 1]].tolist()) for k in (0, 1))
    assert len(x & y) / len(x | y) > 0.98
    assert sum(p == q for p, q in zip(a, b, strict=True)) > 12


def test_links_stay_linear_in_a_group_without_a_centre(spark, monkeypatch):
    """Members that link to few others: tiles give forests, so links follow members, and classes equal brute force."""
    monkeypatch.setattr(near_dedup, "TILE", 64)
    seen = {}
    real = near_dedup.components

    def counted(edges):
        seen["links"] = max(seen.get("links", 0), edges.count())
        return real(edges)

    monkeypatch.setattr(near_dedup, "components", counted)
    rng = np.random.default_rng(12)
    for n in (500, 1000, 2000):
        seen.clear()
        sets = [frozenset(rng.choice(100, 80, replace=False).tolist()) | {1000 + k // 3} for k in range(n)]
        members = spark.createDataFrame([(1, k, len(x)) for k, x in enumerate(sets)], "key long, rep long, n long")
        data = spark.createDataFrame([(k, bytearray(np.sort(np.array(list(x), np.uint64)).tobytes())) for k, x in enumerate(sets)], "rep long, shingles binary")
        out = dict(near_dedup.linked_sets(members, data).collect())
        assert seen["links"] <= 6 * n, (n, seen)
        held = np.zeros((n, 2000), np.float32)
        for k, x in enumerate(sets):
            held[k, list(x)] = 1
        both = held @ held.T
        alike = both >= 0.8 * (held.sum(1)[:, None] + held.sum(1)[None] - both)
        root = np.arange(n)
        while True:
            least = np.where(alike, root[None], n).min(1)
            if (least == root).all():
                break
            root = least
        assert all(out.get(k, k) == root[k] for k in range(n))


def morse(n, swap):
    """Thue-Morse word over a and b: polynomial hashes modulo 2^64 do not tell it from its complement."""
    return "".join("ab"[(bin(k).count("1") + swap) % 2] for k in range(n))


def test_words_that_fool_polynomial_hashes(spark):
    one, two = morse(1024, 0), morse(1024, 1)
    w = near_dedup.Words(near_dedup.pa.array([one, two, one, "abcdefgh" * 100, "abcdefgh" * 100 + "i"]), decontamination.ALNUM, lower=True)
    assert len(set(w.hash.tolist())) == 4 == len(set(w.second.tolist())) and w.hash[0] == w.hash[2]
    assert w.same(np.array([0, 0, 3, 3]), w, np.array([1, 2, 3, 4])).tolist() == [False, True, True, False]
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y"), (3, " ".join([one] * 30)), (4, " ".join([two] * 30)), (5, " ".join([one] * 30))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, one)], "item_id long, text string")
    hit = {r["doc_id"] for r in decontamination.contamination(docs, bench).where("size(spans) > 0").collect()}
    assert hit == {1, 3, 5}
    kept = {r["doc_id"]: r["n_removed"] for r in substring_dedup.without_repeats(docs).collect()}
    assert kept == {1: 0, 2: 0, 3: 29, 4: 29, 5: 30}
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert classes == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_hits_are_verified_on_the_words_themselves(spark, monkeypatch):
    """Even if all words had one hash, only windows whose words are in the document hit."""
    monkeypatch.setattr(decontamination.Words, "span", lambda self, s, e, which=0: np.ones(len(s), np.uint64))
    w = decontamination.Words(decontamination.pa.array(["a b c d", "d c b a b c"]), decontamination.ALNUM, lower=True)
    block = decontamination._Block([(1, "b c"), (2, "c b"), (3, "z")])
    block.order_by({})
    assert sorted(zip(*(x.tolist() for x in block.hits(w)), strict=True)) == [(0, 1), (0, 8), (1, 5)]


def test_long_runs_pack_like_the_library():
    import public_tokenizers

    texts = [" " * 2_000_000 + "a", "\n" * 1_500_000, "a" * 1_000_000, "7" * 1_000_000]
    want = [np.array(tokenizer().encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert packing._Tokens(public_tokenizers.path(packing.TOKENIZER)).ids(texts) == want


# op6 by hand -----------------------------------------------------------------------------------------------------


def brute_templates(shapes):
    """{(host, shape): template} from {(host, shape): [n, labelled, blocked]}, node by node."""
    out = {}

    def walk(host, at, group):
        rests = [rest for _, rest, _ in group]
        lo, hi = min(rests), max(rests)
        shared = len(lo) if lo == hi else next(k for k in range(max(len(lo), len(hi))) if k >= min(len(lo), len(hi)) or lo[k] != hi[k])
        if shared:
            at = "/".join([at] * bool(at) + list(lo[:shared]))
        if lo == hi:
            for shape, _, _ in group:
                out[host, shape] = at
            return
        rows = [(shape, rest[shared:], c) for shape, rest, c in group]
        branches, ahead, total = {}, collections.Counter(), np.zeros(3)
        for _, rest, c in rows:
            seg, nxt = (*rest, "", "")[:2] if len(rest) < 2 else rest[:2]
            b = branches.setdefault(seg, [np.zeros(3), collections.Counter()])
            b[0] += c
            b[1][nxt] += c[0]
            ahead[nxt] += c[0]
            total += c
        rate = total[2] / max(total[1], 1)
        names = {}
        for seg, (c, own) in branches.items():
            distance = 0.5 * sum(abs(own[x] / c[0] - ahead[x] / total[0]) for x in ahead)
            r = c[2] / max(c[1], 1)
            alike = 2 * total[1] >= total[0] if not c[1] else abs(r - rate) <= 2 * math.sqrt(rate * (1 - rate) / max(c[1], 1))
            if seg and len(branches) > 1 and alike and distance <= url_filter.DISTANCE + 1 / math.sqrt(c[0]):
                names[seg] = "*"
            elif seg and len(branches) > url_filter.CHILDREN and c[0] < url_filter.SHARE * total[0]:
                names[seg] = "*" if alike else "*?" if not c[1] else "*+" if r > rate else "*-"
            else:
                names[seg] = seg
        below = collections.defaultdict(list)
        for shape, rest, c in rows:
            name = names[rest[0] if rest else ""]
            below[f"{at}/{name}" if at else name].append((shape, rest[1:], c))
        for name, group in below.items():
            walk(host, name, group)

    for host in {h for h, _ in shapes}:
        walk(host, "", [(s, s, np.array(c, float)) for (h, s), c in shapes.items() if h == host])
    return out


def brute_verdicts(urls, rules):
    """(host, path, rule, verdict) of each url."""
    rows = []
    for url in urls:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fits = [(len(d + p), (a, d, p)) for a, d, p in rules if (host == d or host.endswith("." + d)) and path.startswith(p)]
        action, domain, prefix = max(fits)[1] if fits else (None, None, None)
        plain = re.sub("[0-9]+", "#", re.sub(r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "~", path))
        rows.append((host, path, domain + prefix if fits else None, action, tuple(re.sub("^/", "", plain).split("/"))))
    shapes, pooled = {}, {}
    for host, _, _, action, shape in rows:
        for table, h in ((shapes, host), (pooled, "")):
            c = table.setdefault((h, shape), [0, 0, 0])
            c[0] += 1
            c[1] += action is not None
            c[2] += action == "block"
    own, common = brute_templates(shapes), brute_templates(pooled)
    levels = [collections.defaultdict(lambda: np.zeros(2)) for _ in range(4)]
    keys = {}
    for (host, shape), (_, labelled, blocked) in shapes.items():
        c, domain = common["", shape], ".".join(host.split(".")[-2:])
        keys[host, shape] = [(host, own[host, shape], c), (domain, c), (c,), (host, c)]
        for level, key in zip(levels, keys[host, shape], strict=True):
            level[key] += (blocked, labelled)
    b, n = sum(c[2] for c in shapes.values()), sum(c[1] for c in shapes.values())
    share = (b + 0.5 * url_filter.PRIOR) / (n + url_filter.PRIOR) if n else 0.0
    drawn = lambda c, to: (c[0] + url_filter.PRIOR * to) / (c[1] + url_filter.PRIOR)
    purity, left_out = {}, {}
    for at, (k, d, w, h) in keys.items():
        mine, domain, wide, host = levels[0][k], levels[1][d], levels[2][w], levels[3][h]
        purity[at] = drawn(mine, drawn(domain, drawn(wide, share)))
        left_out[at] = drawn(domain - host, drawn(wide - host, share))
    wrong = [0] * (url_filter.STEPS + 1)
    for at, (_, labelled, blocked) in shapes.items():
        step = min(math.floor(left_out[at] * url_filter.STEPS), url_filter.STEPS - 1)
        for k in range(url_filter.STEPS + 1):
            wrong[k] += blocked if step < k else labelled - blocked
    best = [k for k in range(1, url_filter.STEPS + 1) if wrong[k] == min(wrong)]
    runs = []
    for k in best:
        if runs and runs[-1][-1] == k - 1:
            runs[-1].append(k)
        else:
            runs.append([k])
    run = max(runs, key=lambda r: (len(r), r[0])) if runs else [url_filter.STEPS]
    cut = (run[0] + run[-1]) / 2 / url_filter.STEPS if n else 2.0
    return [(host, path, rule, action or ("block" if purity[host, shape] >= cut else "allow")) for host, path, rule, action, shape in rows]


def test_url_verdicts_against_brute_force(spark):
    """The whole method in plain Python: tree, back-off of purities, cut and verdict, on the tables and on deep paths."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    rng = np.random.default_rng(8)
    for k in range(400):
        host = f"{'abc'[k % 3]}.site{k % 2}.{'net' if k % 4 else 'dev'}"
        urls[10_000 + k] = f"http://{host}/" + "/".join(rng.choice(["es", "fr", "x", "y", f"u{k}", "p"], rng.integers(0, 9))) + ("/" if k % 5 == 0 else "")
    urls[20_000] = "http://deep.net/" + "s/" * 300
    urls[20_001] = "http://deep.net/" + "s/" * 300 + "t"
    df = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(df).collect()}
    assert out == dict(zip(urls, brute_verdicts(urls.values(), url_filter.RULES), strict=True))
    method = collections.Counter(v for _, _, rule, v in out.values() if rule is None)
    assert method["block"] > 20 and method["allow"] > 20


# op7 by hand -----------------------------------------------------------------------------------------------------


def test_pii_precision_and_recall_on_planted_spans(spark):
    """Of planted data that no base pattern holds, most are added; of look-alikes that no one would call personal, few."""
    rng = np.random.default_rng(13)
    digits = lambda n: "".join(rng.choice(list("0123456789"), n))
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    words = lambda n: " ".join("".join(rng.choice(list("abdeinorst"), rng.integers(2, 8))) for _ in range(n))
    card = lambda ok: next(c for c in (digits(16) for _ in range(1000)) if valid("card", c) == ok)
    texts, hidden, decoys = [], [], []
    for k in range(600):
        kind = k % 10
        plain = [f"mail a{k}.{digits(2)}@mail{k % 7}.example.com now", f"call +1 ({digits(3)}) 555-{digits(4)} now", f"paid {card(True)} now", f"from 10.{k % 250}.3.{k % 200} now", f'token = "{hexes(40)}" now', f"api_key: {hexes(32)} now"]
        extra = {6: f"b{k} (at) mail{k % 7}.example (dot) com", 7: f"({digits(3)}) 555-{digits(4)}", 8: card(False), 9: f"{k % 9}{digits(7)}"}
        head = words(5) + (" call " if kind == 7 else " ")
        text = head + (plain[kind] if kind < 6 else extra[kind]) + " " + words(5)
        if kind in (6, 7):
            hidden.append((k, len(head), len(head) + len(extra[kind])))
        elif kind in (4, 5):
            secret = plain[kind].split()[-2].strip('"')
            hidden.append((k, text.index(secret), text.index(secret) + len(secret)))
        elif kind > 7:
            decoys.append((k, len(head), len(head) + len(extra[kind])))
        texts.append((k, text))
    out = pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    added = {(r["doc_id"], s["s"], s["e"]) for r in out for s in r["spans"] if s not in r["base"]}
    found = sum(any(d == i and s < e and b < t for d, b, e in added) for i, s, t in hidden)
    wrong = sum(any(d == i and s < e and b < t for d, b, e in added) for i, s, t in decoys)
    assert found >= 0.9 * len(hidden) and wrong <= 0.05 * len(decoys)
    assert len(added) <= 1.1 * len(hidden)


def test_trees_against_brute_force():
    """The first tree's split is the best of all splits, the margin is the sum of the leaves, calibration never falls."""
    rng = np.random.default_rng(14)
    cells = [({"a": int(a), "b": int(b)}, int(rng.integers(20, 60)), 0) for a in range(4) for b in range(3)]
    cells = [(x, n, int(rng.binomial(n, 0.9 if x["a"] >= 2 and x["b"] else 0.1))) for x, n, _ in cells]
    model = pii.boost(cells, ["a", "b"], trees=5)
    n, y = sum(c for _, c, _ in cells), sum(p for _, _, p in cells)
    q = 1 / (1 + math.exp(-model.start))
    best = {}
    for name in "ab":
        for cut in range(max(x[name] for x, _, _ in cells)):
            sides = [[(p - c * q, c * q * (1 - q)) for x, c, p in cells if (x[name] <= cut) == low] for low in (True, False)]
            best[name, cut] = sum(sum(g for g, _ in s) ** 2 / (sum(h for _, h in s) + 1) for s in sides)
    assert model.trees[0][:2] == max(best, key=best.get) and model.start == pytest.approx(math.log((y + 0.5) / (n - y + 0.5)))
    precise = {pii._calibrated([(3.0, 10, 9), (2.0, 10, 4), (1.0, 10, 6), (0.0, 10, 1)]), pii._calibrated([(3.0, 10, 9), (1.5, 20, 10), (0.0, 10, 1)])}
    assert all(0 < x < 1.5 for x in precise)  # 4 and 6 of 10 are pooled to a half
    assert pii._calibrated([(1.0, 10, 1)]) == math.inf


# op2 by hand -----------------------------------------------------------------------------------------------------


def test_ordinal_fit_is_a_minimum():
    """No small step of a weight or threshold lowers the penalised loss of the cumulative-link model."""
    rng = np.random.default_rng(15)
    n = 6
    rows = [np.flatnonzero(rng.random(n) < 0.4) for _ in range(300)]
    truth = np.linspace(-1, 2, n)
    grade = np.array([sum(truth[r].sum() + rng.logistic() > t for t in (0.5, 1.5, 2.5)) for r in rows])
    weights, theta = toxicity._fit_ordinal(rows, grade, n, steps=3000)

    def loss(w, t):
        total = 0.0
        for r, g in zip(rows, grade, strict=True):
            q = [1.0, *(1 / (1 + math.exp(x - w[r].sum())) for x in t), 0.0]
            total -= math.log(q[g] - q[g + 1])
        return total / len(rows) + 0.5e-4 * (w * w).sum()

    assert (np.diff(theta) > 0).all()
    here = loss(weights, theta)
    for k in range(n + 3):
        for step in (-0.02, 0.02):
            w, t = weights.copy(), theta.copy()
            (w if k < n else t)[k if k < n else k - n] += step
            assert loss(w, t) > here - 1e-6


def test_severity_is_the_expected_grade(spark):
    """Severity by hand: sum of the probabilities of reaching each grade, of the weights of a text's distinct features."""
    ids = np.sort(toxicity.Features(near_dedup.pa.array(["bad worse"])).ids)
    model = toxicity.Model(ids, np.linspace(0.5, 2.0, len(ids)), np.array([0.0, 1.0, 2.5]), 0.6)
    texts = ["bad", "bad worse", "fine", "", "bad bad bad bad"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxicity.severity(rows, model).collect()}
    for k, text in enumerate(texts):
        mine = set(toxicity.Features(near_dedup.pa.array([text])).ids.tolist())
        x = sum(w for i, w in zip(ids.tolist(), model.weights, strict=True) if i in mine)
        p = [1 / (1 + math.exp(t - x)) for t in model.theta]
        assert out[k]["severity"] == pytest.approx(sum(p)) and out[k]["p_toxic"] == pytest.approx(p[0]) and out[k]["toxic"] == (p[0] >= 0.6)


# op9 recall, op5 shared ids --------------------------------------------------------------------------------------


def test_near_copies_at_the_threshold_are_found(spark):
    """Planted pairs of a similarity of 0.8 to 0.9: nearly all are linked, and no pair below 0.8."""
    rng = np.random.default_rng(16)
    docs, want = [], []
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 204)]
        other = list(words)
        for at in sorted(rng.choice(np.arange(5, 199, 6), int(rng.integers(1, 6)), replace=False)):
            other[at] = f"n{k}x{at}"
        x, y = shingles(" ".join(words)), shingles(" ".join(other))
        want.append(len(x & y) / len(x | y) >= 0.8)
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    out = dict(near_dedup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    got = [out[2 * k] == out[2 * k + 1] for k in range(300)]
    assert sum(w for w in want) > 150 and sum(g and w for g, w in zip(got, want, strict=True)) >= 0.99 * sum(want)
    assert not any(g and not w for g, w in zip(got, want, strict=True))


def test_substrings_of_shared_and_missing_ids(spark):
    """Rows without an id, of one id and repeated as a whole: in the operator's fixed order each window stays once."""
    text = lambda s, n: " ".join(f"{s}{k}" for k in range(n))
    rows = [(None, text("a", 30)), (None, text("b", 10)), (None, text("a", 30)), (None, text("a", 30)), (7, text("c", 25)), (7, text("d", 25)), (7, text("c", 25)), (8, text("d", 25) + " " + text("a", 30)), (None, "x"), (None, "x"), (None, None)]
    out = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out)
    assert got == collections.Counter({(None, 30, 0, text("a", 30)): 1, (None, 30, 30, ""): 2, (None, 10, 0, text("b", 10)): 1, (7, 25, 0, text("c", 25)): 1, (7, 25, 25, ""): 1, (7, 25, 0, text("d", 25)): 1, (8, 55, 55, ""): 1, (None, 1, 0, "x"): 2, (None, 0, 0, ""): 1})


def test_lm_scores_do_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    training = F.col("doc_id") % 3 != 0
    one = dict(lm_scoring.score(docs.coalesce(1), training).select("doc_id", "score").collect())
    many = dict(lm_scoring.score(docs.repartition(7), training).select("doc_id", "score").collect())
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], rel=1e-4) for k in one)


def test_lm_learns_from_every_token(spark):
    """Each unit of each training document is a target exactly once, whatever the length."""
    units = [np.arange(n, dtype=np.int16) + 1 for n in (1, 5, lm_scoring.SPAN, lm_scoring.SPAN + 1, 3 * lm_scoring.SPAN + 7)]
    batch = near_dedup.pa.record_batch([near_dedup.pa.array(range(5), near_dedup.pa.int64()), near_dedup.pa.array([x.tobytes() for x in units])], names=["mark", "units"])
    (out,) = lm_scoring._spans([batch])
    spans = [np.frombuffer(x, np.int16) for x in out.column("span").to_pylist()]
    assert collections.Counter(x for s in spans for x in s[1:].tolist()) == collections.Counter(x for u in units for x in u.tolist())
    lanes = lm_scoring._Lanes(spans)
    assert lanes.tokens == sum(map(len, units)) == lanes.live.sum() and lanes.fresh.sum() == len(spans)
    assert sorted(lanes.targets[lanes.live].tolist()) == sorted(x for u in units for x in u.tolist())

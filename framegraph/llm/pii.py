"""Personal data: exact patterns, and boosted trees over high-recall candidates.

DataFrame operations only; what reaches the driver is a table of feature cells with counts, whose size the number of
bins bounds. Fixed patterns give the base spans of four kinds. Wide generators propose further, overlapping spans
(numbers with separators, spelled-out addresses, long mixed tokens). Each candidate gets binned features of its
format and of its context.

No one marks personal data, so labels are weak and come from two sides: a candidate is a positive where its format
holds (it meets a base span, or is an address in plain form) or where its context says so (a credential or contact word introduces it) and no checksum
speaks against it. The trees see every candidate three times: whole, with its context hidden, and with its format
hidden. So what context has marked teaches formats (of keys and tokens), and what format has marked teaches contexts.
Spelled-out addresses are put in plain form first, so that they look like others. Trees are grown on four fifths of the
documents; the margins are calibrated by isotonic regression on the last fifth, and candidates whose calibrated
precision is high enough are added. Base spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, materialize, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: The contract's patterns. Possessive where giving back cannot help; a match starts only where the
#: last one ended or a run starts, which leaves the matches as they are and long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide generators.
WIDE = {
    "address": r"(?:\G|(?<![\p{L}0-9._%+-]))[\p{L}0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[\p{L}0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\p{L}0-9-]++)*+",
    "number": r"(?:\G|(?<![0-9]))\+?\(?[0-9](?:[\x20().:/-]{0,2}+[0-9]){6,}+",
    "dotted": r"(?:\G|(?<![0-9A-Fa-f:.]))[0-9A-Fa-f]{1,4}+(?:[.:][0-9A-Fa-f]{1,4}+){3,}+",
    "token": r"(?:\G|(?<![A-Za-z0-9_/+-]))[A-Za-z0-9_/+-]{24,}+={0,2}+",
}
#: Trees, their step, and the share of positives among like candidates from which one is added: those without a mark
#: are not all something else, so half is enough. A leaf holds LEAST candidates or more.
TREES, RATE, PRECISION, LEAST = 24, 0.4, 0.5, 10
#: One document in HELD is left to calibration, unless its positives are fewer than ENOUGH: then all documents calibrate.
HELD, ENOUGH = 5, 20
#: Words that introduce credentials and numbers, up to the candidate.
INTRODUCED = {
    "token": r"(?:key|token|secret|passw(?:or)?d|pwd|auth|bearer|credentials?)[a-z_-]{0,12}+\s{0,2}(?:[=:]|=>|\bis\b)\s{0,2}[\x22\x27]?$",
    "number": r"(?:tel|phone|mobile|fax|call|ring|contact)[a-z]{0,6}+\s{0,2}[.:]?\s{0,2}$",
}
#: Elements that are summed at a time.
BLOCK = 512


def _sums_before(steps: Column) -> Column:
    """At each place the sum of all earlier steps; block by block, so that a long array does not cost its square."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
    add = lambda done, x: F.struct((done["at"] + x).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    inside = F.transform(cut, lambda x: F.aggregate(x, start, add))
    bases = F.aggregate(inside, start, lambda done, x: add(done, x["at"]), lambda done: done["out"])
    whole = F.flatten(F.zip_with(inside, bases, lambda x, base: F.transform(x["out"], lambda o: o + base)))
    return F.when(F.size(steps) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _spans(rows: DataFrame, patterns: dict[str, str], gates: dict[str, Column]) -> DataFrame:
    """rows (doc_id, text) with an array<struct<s,e,m,before,after>> of leftmost non-overlapping matches for each pattern,
    in code points, in place of the text; ungated texts are not looked at.

    In steps of their own, so that each pattern runs once over a text and each array is made once.
    """
    cut = F.array().cast("array<string>")
    pieces = {k: F.when(gates[k], F.split("text", p, -1)).otherwise(cut) for k, p in patterns.items()}
    found = {k: F.when(gates[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(cut) for k, p in patterns.items()}
    rows = rows.select("doc_id", *(v.alias("p_" + k) for k, v in pieces.items()), *(v.alias("m_" + k) for k, v in found.items()))
    steps = lambda k: F.zip_with(F.slice("p_" + k, F.lit(1), F.size("m_" + k)), "m_" + k, lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
    rows = rows.select("*", *(steps(k).alias("n_" + k) for k in patterns))
    rows = rows.select("*", *(_sums_before(F.col("n_" + k)).alias("a_" + k) for k in patterns))

    def spans(k: str) -> Column:
        around = F.zip_with("a_" + k, F.slice("p_" + k, F.lit(2), F.size("m_" + k)), lambda at, n: F.struct(at.alias("at"), F.substring(n, 1, 1).alias("n")))
        pairs = F.zip_with(F.slice("p_" + k, F.lit(1), F.size("m_" + k)), "m_" + k, lambda p, m: F.struct(p.alias("p"), m.alias("m")))

        def hit(x, y):
            s = y["at"] + F.length(x["p"])
            return F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), F.right(x["p"], F.lit(32)).alias("before"), y["n"].alias("after"))

        return F.zip_with(pairs, around, hit)

    return rows.select("doc_id", *(spans(k).alias(k) for k in patterns))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total, k):
        x = F.try_to_number(F.substring(back, k, F.lit(1)), F.lit("9")).cast("int")
        return total + F.when(k % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(m))).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


#: Feature: expression over a candidate c (and its generator g), giving a small whole number; those of the format, then
#: those of the context. Digits that look like a card or an address of four parts have check 2 if they hold as one, else 1.
FORMAT = {
    "generator": "g",
    "digits": "case when c.digits = 0 then 0 when c.digits < 9 then 1 when c.digits < 13 then 2 when c.digits < 20 then 3 else 4 end",
    "length": "case when length(c.m) < 8 then 0 when length(c.m) < 13 then 1 when length(c.m) < 20 then 2 when length(c.m) < 41 then 3 when length(c.m) < 129 then 4 else 5 end",
    "dots": "least(length(regexp_replace(c.m, '[^.]', '')), 4)",
    "at": "int(contains(c.m, '@'))",
    "gaps": "least(length(regexp_replace(c.m, '[^ ()-]', '')), 3)",
    "check": "case when rlike(c.m, '^[0-9]+([.][0-9]+){3}$') then if(forall(split(c.m, '[.]'), p -> coalesce(try_cast(p as int) <= 255, false)), 2, 1) when c.digits >= 13 and not rlike(c.m, '[A-Za-z_/=]') then if(not rlike(c.m, '[^0-9 -]|[ -]{2}') and luhn_check(regexp_replace(c.m, '[^0-9]', '')), 2, 1) else 0 end",
    "letters": "case when c.letters = 0 then 0 when c.letters * 2 < length(c.m) then 1 else 2 end",
    # distinct characters of a long token, and how often letters and digits take turns
    "variety": "case when length(c.m) < 24 then 0 when size(array_distinct(split(left(c.m, 64), ''))) < 8 then 1 else 2 end",
    "turns": "case when c.digits = 0 or c.letters = 0 then 0 when size(regexp_extract_all(left(c.m, 64), '[A-Za-z](?=[0-9])', 0)) < 4 then 1 else 2 end",
}
CONTEXT = {
    "told": "int(c.told)",
    "before": "case when rlike(c.before, '[=:]\\\\s*[\"\\']?$') then 3 when rlike(c.before, '[\"\\'(<]$') then 2 when c.before = '' or rlike(c.before, '\\\\s$') then 1 else 0 end",
    "after": "case when c.after is null or c.after = '' or rlike(c.after, '\\\\s') then 0 when rlike(c.after, '[.,;:!?)\"\\']') then 1 else 2 end",
}
FEATURES = FORMAT | CONTEXT


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, wide): base spans (kind, s, e) and candidates (kind, s, e, their features and whether they meet a base span)."""
    rows = id_and_text(docs)
    text = F.col("text")
    numeric = text.rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "ip": numeric, "card": numeric, "phone": F.contains(text, F.lit("+")), "address": F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]"), "number": numeric, "dotted": numeric | F.contains(text, F.lit("::")), "token": text.rlike(WIDE["token"])}
    found = _spans(rows, BASE | WIDE, gates)
    at, dot = r"\x20?[(\[]at[)\]]\x20?", r"\x20?[(\[]dot[)\]]\x20?"
    found = found.withColumn("address", F.transform("address", lambda c: c.withField("m", F.regexp_replace(F.regexp_replace(c["m"], at, "@"), dot, "."))))

    def valid_spans(kind: str) -> Column:
        kept = F.filter(F.col(kind), lambda x: _valid(kind, x["m"]))
        return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    base = F.concat(*(valid_spans(k) for k in BASE))
    found = found.withColumn("base", base)
    wide = []
    for g, name in enumerate(WIDE):
        told = f"rlike(lower(c.before), r'{INTRODUCED[name]}')" if name in INTRODUCED else "false"
        counted = f"transform({name}, c -> struct(c.s, c.e, c.m, c.before, c.after, length(regexp_replace(c.m, '[^0-9]', '')) as digits, length(regexp_replace(c.m, '[^A-Za-z]', '')) as letters, {told} as told))"
        # an address in plain form is held against the base pattern as a whole
        holds = r"rlike(c.m, r'^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+$')" if name == "address" else "false"
        features = [f"{str(g) if e == 'g' else e} as {f}" for f, e in FEATURES.items()]
        wide.append(f"transform({counted}, c -> struct('{name}' as generator, c.s as s, c.e as e, c.m as m, exists(base, b -> b.s < c.e and c.s < b.e) as met, {holds} as holds, struct({', '.join(features)}) as x))")
    return found.select("doc_id", "base", F.expr(f"concat({', '.join(wide)})").alias("wide"))


class Trees:
    """Gradient-boosted trees of depth two over cells of binned features."""

    def __init__(self, names: list[str]):
        self.names, self.start, self.trees, self.threshold = names, 0.0, [], 2.0

    def margin(self, x: dict) -> float:
        return self.start + sum(self._leaf(t, x) for t in self.trees)

    @staticmethod
    def _leaf(tree, x: dict) -> float:
        while isinstance(tree, tuple):
            name, cut, low, high = tree
            tree = low if x[name] <= cut else high
        return tree

    def sql(self) -> str:
        """The margin as an expression over a struct x."""

        def leaf(tree) -> str:
            return f"case when x.{tree[0]} <= {tree[1]} then {leaf(tree[2])} else {leaf(tree[3])} end" if isinstance(tree, tuple) else f"{tree!r}D"

        return " + ".join([f"{self.start!r}D", *(leaf(t) for t in self.trees)])


def _calibrated(scored: list[tuple[float, int, int]]) -> float:
    """Of (margin, candidates, positives): the margin midway between precise and other candidates.

    Precision as a function of the margin is the isotonic fit: neighbours out of order are pooled.
    """
    blocks: list[list[float]] = []
    for margin, n, y in sorted(scored, reverse=True):
        blocks.append([margin, n, y])
        while len(blocks) > 1 and (blocks[-1][0] == blocks[-2][0] or blocks[-1][2] * blocks[-2][1] > blocks[-2][2] * blocks[-1][1]):
            margin, n, y = blocks.pop()
            blocks[-1] = [margin, blocks[-1][1] + n, blocks[-1][2] + y]
    precise = sum(y >= PRECISION * n for _, n, y in blocks)
    if not precise:
        return float("inf")
    return sum(block[0] for block in blocks[precise - 1 : precise + 1]) / len(blocks[precise - 1 : precise + 1]) - 1e-9


def boost(cells: list[tuple[dict, int, int]], names: list[str], trees: int = TREES, held: list[tuple[dict, int, int]] | None = None) -> Trees:
    """cells: (features, candidates, positives among them). Newton boosting with an L2 penalty of one; held: for calibration."""
    model = Trees(names)
    n, y = sum(c for _, c, _ in cells), sum(p for _, _, p in cells)
    if not n:
        return model
    model.start = math.log((y + 0.5) / (n - y + 0.5))
    margins = [model.start] * len(cells)

    def grow(at: list[int], depth: int, slopes: list[tuple[float, float]]):
        g, h, total = sum(slopes[k][0] for k in at), sum(slopes[k][1] for k in at), sum(cells[k][1] for k in at)
        best = None
        for name in names if depth else ():
            by: dict[int, list[float]] = {}
            for k in at:
                own = by.setdefault(cells[k][0][name], [0.0, 0.0, 0])
                own[0] += slopes[k][0]
                own[1] += slopes[k][1]
                own[2] += cells[k][1]
            gl = hl = below = 0
            for cut in sorted(by)[:-1]:
                gl, hl, below = gl + by[cut][0], hl + by[cut][1], below + by[cut][2]
                if min(below, total - below) < LEAST:
                    continue
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, name, cut)
        if best is None:
            return RATE * g / (h + 1)
        _, name, cut = best
        low, high = [k for k in at if cells[k][0][name] <= cut], [k for k in at if cells[k][0][name] > cut]
        return (name, cut, grow(low, depth - 1, slopes), grow(high, depth - 1, slopes))

    for _ in range(trees):
        slopes = []
        for m, (_, c, p) in zip(margins, cells, strict=True):
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, m))))
            slopes.append((p - c * q, c * q * (1 - q)))
        tree = grow(list(range(len(cells))), 2, slopes)
        model.trees.append(tree)
        margins = [m + model._leaf(tree, x) for m, (x, _, _) in zip(margins, cells, strict=True)]
    scored = zip(margins, cells, strict=True) if held is None else ((model.margin(x), (x, c, y)) for x, c, y in held)
    model.threshold = _calibrated([(m, c, y) for m, (_, c, y) in scored])
    return model


def views(cells: list[tuple[dict, int, int]]) -> list[tuple[dict, int, int]]:
    """Each cell whole, without its context and without its format but for the generator; equal ones put together."""
    out: dict[tuple, list[int]] = {}
    for hidden in ((), tuple(CONTEXT), tuple(x for x in FORMAT if x != "generator")):
        for x, n, y in cells:
            own = out.setdefault(tuple(-1 if f in hidden else x[f] for f in FEATURES), [0, 0])
            own[0] += n
            own[1] += y
    return [(dict(zip(FEATURES, x, strict=True)), n, y) for x, (n, y) in sorted(out.items())]


def learn(found: DataFrame) -> Trees:
    """Trees from the candidates of `candidates`; without candidates, trees that add nothing."""
    positive = (F.col("c.met") | F.col("c.holds") | (F.col("c.x.told") == 1)) & (F.col("c.x.check") != 1)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0
    each = found.select(held.alias("held"), F.explode("wide").alias("c")).select("held", "c.x", positive.alias("y"))
    cells = each.groupBy("held", "x").agg(F.count("*").alias("n"), F.count_if("y").alias("y")).collect()  # as many rows as bins have combinations
    rows = [(r["held"], (r["x"].asDict(), r["n"], r["y"])) for r in sorted(cells, key=lambda r: (r["held"], tuple(r["x"])))]
    apart = [c for h, c in rows if h]
    enough = sum(y for _, _, y in apart) >= ENOUGH
    return boost(views([c for h, c in rows if not (h and enough)]), list(FEATURES), held=apart if enough else [c for _, c in rows])


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (kind, s, e); spans holds base and the added ones.

    Positions are code points, the end exclusive. An added span never overlaps a base span or another added one of a
    higher margin (the earlier, then longer one of equals stays). Null or empty texts have no spans, long texts are read
    whole, repeated rows give repeated rows, an empty table none; further columns of any name are not looked at.
    """
    found = materialize(candidates(docs))
    model = learn(found)
    # every document's candidates get their margins by one expression
    margin = model.sql()
    kind = "case c.generator when 'address' then 'email' when 'dotted' then 'ip' when 'token' then 'secret' else case when startswith(c.m, '+') then 'phone' when length(regexp_replace(c.m, '[^0-9]', '')) >= 13 then 'card' else 'phone' end end"
    threshold = repr(model.threshold) + "D" if math.isfinite(model.threshold) else "double('Infinity')"
    scored = found.withColumn("likely", F.expr(f"filter(transform(filter(wide, c -> not c.met), c -> struct(-({margin.replace('x.', 'c.x.')}) as margin, c.s as s, -c.e as e, {kind} as kind)), c -> -c.margin >= {threshold})"))
    added = F.expr(
        "aggregate(array_sort(likely), cast(array() as array<struct<kind:string,s:bigint,e:bigint>>), (done, c) ->"
        " if(exists(done, d -> d.s < -c.e and c.s < d.e), done, concat(done, array(struct(c.kind as kind, c.s as s, -c.e as e)))))"
    )
    return scored.select("doc_id", "base", F.concat("base", added).alias("spans"))


def _listed(spans: str) -> Column:
    order = " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS))
    ordered = F.expr(f"array_sort(transform({spans}, c -> struct(case c.kind {order} end as k, c.s as s, c.e as e, c.kind as kind)))")
    return F.concat_ws(",", F.transform(ordered, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    n = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *n, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))

"""Secret scans behind a trigram inverted index, with DataFrame functions only.

Every rule is a regular expression. From each the driver derives a Boolean query over lower-cased trigrams: an OR of ANDs that any
text with a match must satisfy (``trigram_query``). The index is a table of postings ``gram, doc_id, row`` for the trigrams that
some rule asks for (others would never be read), sorted by trigram within each file, so a later scan reads its trigrams alone. A scan
intersects the postings: each sets its trigram's bit, a text's bits are ORed (map-side first, so one small row a text is shuffled)
and each rule's query is a comparison of bits. Texts that satisfy a rule's query are its candidates; they are joined back by id and
text hash and verified with the expression itself. Rules without a mandatory trigram are matched against all texts in place.

Positions are code points: the pieces between matches and the matches follow each other, so a running sum of their lengths gives
every start. ``row`` is a 64-bit hash of the text; together with the id it tells rows apart.

If the candidates are too many to broadcast, Spark shuffles the texts once for verification; otherwise texts stay where they are.

Defined cases: null and empty texts have no spans; repeated rows stay repeated, each with the same result, and are verified once for
each copy but counted once; rows without an id keep a null id; overlapping spans of different kinds all stay; very long texts are
matched whole, their spans are numbered by a window over one text and rule; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from functools import reduce
from re import _constants as re_names, _parser as re_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from canopyframe.session import cut

MAX_STRINGS = 64
MAX_CLAUSES = 128
BITS = 62


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: this group's match has at least so many characters, or the match is dropped
    group: int = 0
    least: int = 1


def either_case(pattern: str) -> str:
    """Letters of a pattern (without classes or escapes) in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern)


# Fixed values of the contract: kinds, patterns, groups and lengths.
BASE = [
    Rule("assign", f"({either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),  # runs of 24 and more are the longest runs of hex digits with 24 and more
]
# Public formats of credentials.
MORE = [
    Rule("github", "gh[opusr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", "xox[abeprs]-[A-Za-z0-9-]{10,255}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,255}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}"),
    Rule("pem", "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("url", r"://[^\x00-\x20/:@]{1,250}:[^\x00-\x20/@]{1,250}@"),
]
RULES = [*BASE, *MORE]

Clauses = frozenset  # of frozensets of trigrams: any of them, whole
ALL: Clauses = frozenset([frozenset()])


def _shortest(clauses) -> Clauses:
    """Without clauses that hold another."""
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    joined = _shortest({x | y for x in a for y in b}) if len(a) * len(b) <= MAX_CLAUSES ** 2 else a
    return joined if len(joined) <= MAX_CLAUSES else min(a, b, key=len)  # either alone is still mandatory


def _grams(strings: set[str]) -> Clauses:
    return _shortest({frozenset(s[i: i + 3] for i in range(len(s) - 2)) for s in strings})


def _letters(kind, value) -> set[str] | None:
    """The lower-cased characters of a literal or a small class."""
    if kind is re_names.LITERAL:
        return {chr(value).lower()} if value < 128 else None
    if kind is not re_names.IN or value[0][0] is re_names.NEGATE:
        return None
    out: set[str] = set()
    for sort, x in value:
        low, high = (x, x) if sort is re_names.LITERAL else x if sort is re_names.RANGE else (0, 128)
        if high > 127 or high - low >= MAX_STRINGS:
            return None
        out |= {chr(c).lower() for c in range(low, high + 1)}
    return out


def _node(kind, value) -> tuple[set[str] | None, Clauses]:
    """The exact strings of a node where they are few (else None), and what any match must hold."""
    if kind in (re_names.LITERAL, re_names.IN):
        return _letters(kind, value), ALL
    if kind in (re_names.AT, re_names.ASSERT, re_names.ASSERT_NOT):
        return {""}, ALL
    if kind is re_names.SUBPATTERN:
        return _sequence(value[3])
    if kind is re_names.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        strings = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
        return strings, _shortest(set().union(*(q for _, q in parts)))
    if kind in (re_names.MAX_REPEAT, re_names.MIN_REPEAT, re_names.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, need = _sequence(inner)
        if low == 0:
            return ({"", *strings} if strings is not None and high == 1 else None), ALL
        if strings is None or len(strings) ** low > MAX_STRINGS:
            return None, need
        times = reduce(lambda a, _: {x + y for x in a for y in strings}, range(low), {""})
        return (times if high == low else None), _grams(times)
    return None, ALL


def _sequence(nodes) -> tuple[set[str] | None, Clauses]:
    run, need, exact = {""}, ALL, True
    for kind, value in nodes:
        strings, inner = _node(kind, value)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        exact = False
        need = _both(_both(need, _grams(run)), inner)
        run = strings if strings is not None and len(strings) <= MAX_STRINGS else {""}
    return (run if exact else None), _both(need, _grams(run))


def trigram_query(pattern: str) -> Clauses:
    """Sets of lower-cased trigrams: every text with a match holds all of one of them. ``ALL`` if nothing is mandatory."""
    return _sequence(re_parser.parse(pattern))[1]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(value).alias("row"), value.alias("text"))


def index(texts: DataFrame, grams: list[str]) -> DataFrame:
    """Postings ``gram, doc_id, row`` of the given trigrams, written as a table."""
    # lower() may also fold letters beyond ASCII; that only adds postings
    low = texts.select("doc_id", "row", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return cut(low.select("doc_id", "row", F.explode(held).alias("gram")).sortWithinPartitions("gram"))


def candidates(postings: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id, row, rules``: texts that satisfy the trigram query of some rule (by its place in ``rules``), written as a table."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ALL}
    grams = sorted({g for q in queries.values() for c in q for g in c})
    place = {g: divmod(i, BITS) for i, g in enumerate(grams)}
    words = range(-(-len(grams) // BITS))
    bits = postings.sparkSession.createDataFrame([(g, *[1 << place[g][1] if place[g][0] == w else 0 for w in words]) for g in grams],
                                                 "gram string" + "".join(f", m{w} long" for w in words))
    masks = (postings.where(F.col("gram").isin(grams)).join(F.broadcast(bits), "gram")  # as many rows as the rules have trigrams
             .groupBy("doc_id", "row").agg(*[F.bit_or(f"m{w}").alias(f"m{w}") for w in words]))

    def holds(clause) -> Column:
        wanted = [sum(1 << place[g][1] for g in clause if place[g][0] == w) for w in words]
        return reduce(Column.__and__, [F.col(f"m{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in enumerate(wanted) if m])

    found = [F.when(reduce(Column.__or__, [holds(c) for c in sorted(q, key=sorted)]), F.lit(k)) for k, q in queries.items()]
    return cut(masks.select("doc_id", "row", F.array_compact(F.array(*found)).alias("rules")).where(F.size("rules") > 0))


def matched(text: Column, wanted: Column, rule: Rule, k: int) -> Column:
    """Matches of a rule in order: ``rule``, the gap before, the length and the length of the rule's group."""
    p = F.lit(rule.pattern)
    whole, part = (F.regexp_extract_all(text, p, F.lit(g)) for g in (0, rule.group))
    sizes = F.zip_with(whole, part, lambda w, v: F.struct(F.char_length(w).alias("size"), F.char_length(v).alias("part")))
    rows = F.zip_with(F.split(text, rule.pattern, -1), sizes, lambda gap, m: F.struct(F.lit(k).alias("rule"), F.char_length(gap).alias("gap"), m["size"].alias("size"), m["part"].alias("part")))
    return F.when(wanted & text.rlike(rule.pattern), F.filter(rows, lambda m: m["size"].isNotNull())).otherwise(F.array().cast("array<struct<rule:int,gap:int,size:int,part:int>>"))


def found(texts: DataFrame, rules: dict[int, Rule], wanted: Column | None, mark: bool = False) -> DataFrame:
    """One row a match (``doc_id, row, pos, rule, gap, size, part``); with ``mark`` also one of rule -1 for each text."""
    parts = [matched(F.col("text"), F.lit(True) if wanted is None else F.array_contains(wanted, k), r, k) for k, r in rules.items()]
    if mark:
        parts.append(F.array(F.struct(F.lit(-1).alias("rule"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(0).alias("part"))))
    return texts.select("doc_id", "row", F.posexplode(F.concat(*parts)).alias("pos", "m")).select("doc_id", "row", "pos", "m.*")


def spans(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text", postings: DataFrame | None = None) -> DataFrame:
    """``doc_id, row, rule, start, end, copies``: every span, and for each text a row of rule -1 with its number of copies.

    ``postings`` is an index of the same texts that holds the rules' trigrams; without one it is built.
    """
    texts = keyed(docs, doc_id, text)
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    grams = sorted({g for q in queries.values() for c in q for g in c})
    everywhere = found(texts, {k: r for k, r in enumerate(rules) if queries[k] == ALL}, None, mark=True)
    if grams:
        wanted = candidates(index(texts, grams) if postings is None else postings, rules)
        pair = texts.alias("t").join(wanted.alias("c"), F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.row") == F.col("c.row"))).select("t.doc_id", "t.row", "t.text", "c.rules")
        everywhere = everywhere.unionByName(found(pair, {k: r for k, r in enumerate(rules) if queries[k] != ALL}, F.col("rules")))
    key = ["doc_id", "row", "rule"]
    once = everywhere.groupBy(*key, "pos").agg(F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("part").alias("part"), F.count(F.lit(1)).alias("copies"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    least = reduce(lambda c, k: c.when(F.col("rule") == k, rules[k].least), range(len(rules)), F.when(F.col("rule") < 0, 0))
    return once.withColumn("end", end).where(F.col("part") >= least).select(*key, (F.col("end") - F.col("size")).alias("start"), "end", "copies")


def scan(docs: DataFrame, rules: list[Rule] = RULES, base: int = len(BASE), doc_id: str = "doc_id", text: str = "text", postings: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``n_<kind>`` of the first ``base`` rules, ``base_sha256`` and ``spans`` of every row.

    Spans read ``kind:start:end`` in the order of their starts, then of the rules; the hash is that of the first ``base`` rules' spans.
    """
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    joined = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", F.get(kinds, x["rule"]), x["start"], x["end"])))
    real = F.col("rule") >= 0
    each = (spans(docs, rules, doc_id, text, postings).groupBy("doc_id", "row")
            .agg(F.max(F.when(~real, F.col("copies"))).alias("copies"), F.array_sort(F.collect_list(F.when(real, F.struct("start", "rule", "end")))).alias("s"),
                 *[F.count(F.when(F.col("rule") == k, 1)).alias(f"n_{rules[k].kind}") for k in range(base)]))
    out = each.select("doc_id", "copies", *[f"n_{r.kind}" for r in rules[:base]], F.sha2(joined(F.filter("s", lambda x: x["rule"] < base)), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "copy")


def scan_sql(rules: list[Rule] = RULES, base: int = len(BASE)) -> str:
    """The same result by plain matching of all rules against all texts."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    one = " union all ".join(
        f"""select rid, {k} as rule, '{r.kind}' as kind, unnest(list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'a': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0),
            'n': length(w[i]), 'g': length(g[i])}}), lambda x: x.g >= {r.least})) as s
        from (select rid, string_split_regex(text, {quoted(r.pattern)}) as p, regexp_extract_all(text, {quoted(r.pattern)}) as w, regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) as g from d where regexp_matches(text, {quoted(r.pattern)}))"""
        for k, r in enumerate(rules))
    counts = ", ".join(f"count(*) filter (rule = {k}) as n_{r.kind}" for k, r in enumerate(rules[:base]))
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
found as (select rid, rule, cast(s.a as bigint) as start, kind || ':' || cast(s.a as bigint) || ':' || cast(s.a + s.n as bigint) as said from ({one})),
told as (select rid, {counts}, string_agg(said, ',' order by start, rule) filter (rule < {base}) as base, string_agg(said, ',' order by start, rule) as spans from found group by 1)
select doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) as n_{r.kind}' for r in rules[:base])}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join told using (rid)"""

"""Secret scans with DataFrame functions only.

Fixed-form secrets come from regular expressions; other candidates (runs of token characters) are
scored by the Shannon entropy of a sliding window, kept up to date by the counts of the entering
and the leaving character, with a threshold per character class and an allow-list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group of the value, least length of that group. For access and hex a dropped
#: match can hold no other match, so the least length stands in the pattern.
BASE = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]{14,})", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
]
ORDER = [k for k, *_ in BASE] + ["entropy"]
#: Characters of a window, and of the shortest candidate.
WINDOW = 20
#: The characters of a candidate.
SLOTS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE = r"([A-Za-z0-9+/_-]{20,}={0,2})"
#: Class, pattern of the whole candidate, least entropy of a window in bits. The first match counts.
CLASSES = [
    ("hexadecimal", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.05),
    ("alphanumeric", r"^[A-Za-z0-9]+$", 3.55),
    ("base64", r"^[A-Za-z0-9+/_-]+={0,2}$", 3.75),
]
#: Candidates that are never reported.
ALLOW = [
    r"^[A-Za-z+/_-]+=*$",  # no digit: prose, paths, identifiers
    r"^[0-9+/_-]+=*$",  # no letter: numbers, dates, rules
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^(?:[a-z]++|[0-9]++)(?:[-_/](?:[a-z]++|[0-9]++))++$",  # slugs; possessive, as a repeated group recurses otherwise
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0000000|1234567",
]


#: Items that are folded at a time, and characters of a piece of a text that is cut.
FOLD, PIECE = 256, 4096


def prefixes(values: str, op: str, zero: str, kind: str = "bigint") -> str:
    """SQL for what ``op`` (over a, b) makes of all values before each place of an array.

    A fold that appends to an array copies it every time; so blocks are folded by themselves, then
    the blocks' totals, and both are put together. The work grows with the number of values.
    """
    def fold(over, of):
        return f"""aggregate({over}, named_struct('at', {zero}, 'out', CAST(array() AS array<{kind}>)),
            (a, b) -> named_struct('at', {op.format(a='a.at', b=of)}, 'out', array_append(a.out, a.at)))"""

    blocks = f"transform(sequence(0, greatest(size(v) - 1, 0) div {FOLD}), k -> slice(v, k * {FOLD} + 1, {FOLD}))"
    joined = f"flatten(zip_with(l, {fold('l', 'b.at')}.out, (x, c) -> transform(x.out, y -> {op.format(a='c', b='y')})))"
    return f"transform(array({values}), v -> transform(array(transform({blocks}, x -> {fold('x', 'b')})), l -> {joined})[0])[0]"


def _spans(kind: str, gaps: str, hits: str, values: str, least: int) -> Column:
    """array<struct<start,k,end,kind>> from the parts between the matches and the matches."""
    k = ORDER.index(kind)
    lengths = prefixes("zip_with(m.g, m.h, (g, h) -> cast(length(g) + coalesce(length(h), 0) AS bigint))", "{a} + {b}", "0L")
    # everything is bound outside of the inner lambdas: what stands inside one is worked out anew for each element
    all_ = f"""transform(array(named_struct('g', {gaps}, 'h', {hits}, 'v', {values})), m -> transform(array({lengths}), at -> filter(transform(m.h, (h, i) ->
        IF(length(m.v[i]) >= {least}, named_struct('start', at[i] + length(m.g[i]), 'k', {k}, 'end', at[i] + length(m.g[i]) + length(h), 'kind', '{kind}'), NULL)), x -> x IS NOT NULL))[0])[0]"""
    return F.expr(f"IF(size({hits}) = 0, CAST(array() AS array<struct<start:bigint,k:int,end:bigint,kind:string>>), {all_})")


def runs(spans: str, touch: str) -> str:
    """SQL for the maximal runs (start, end) of spans in order; a span joins the run before if its start is ``touch`` (< or <=) the run's end."""
    last = prefixes("transform(p, s -> s.end)", "greatest({a}, {b})", "-1L")
    first = f"filter(transform(p, (s, i) -> named_struct('start', s.start, 'before', m[i])), x -> NOT (x.start {touch} x.before))"
    ends = "array_append(slice(f, 2, size(f)), named_struct('start', 0L, 'before', array_max(transform(p, s -> s.end))))"
    return f"""transform(array({spans}), p -> IF(size(p) = 0, CAST(array() AS array<struct<start:bigint,end:bigint>>), transform(array({last}), m -> transform(array({first}), f ->
        zip_with(f, {ends}, (x, y) -> named_struct('start', x.start, 'end', y.before)))[0])[0]))[0]"""


def window_entropy(s: str, w: int = WINDOW) -> str:
    """SQL for the greatest entropy of a window of ``w`` characters in the string ``s``.

    With T = sum of c*log2(c) over the counts c of a window, its entropy is log2(w) - T/w. The
    counts are an array with a slot per character of a candidate. A character that enters when its
    count was c adds g(c+1) - g(c), one that leaves takes the same away, where g(c) = c*log2(c).
    """
    g = f"array({', '.join('0D' if c < 2 else f'{c} * log2({c}D)' for c in range(w + 2))})"
    # x: slots of the characters; the window first loses slot o (at its full length), then gets slot n
    step = f"""transform(array(named_struct('n', x[i], 'o', IF(i >= {w}, x[i - {w}], -1))), z -> transform(array(named_struct(
            'cn', a.c[z.n] - IF(z.o = z.n, 1, 0), 'co', IF(z.o < 0, 0, a.c[z.o]))), y -> transform(array(
                a.t + g[y.cn + 1] - g[y.cn] - IF(z.o < 0, 0D, g[y.co] - g[y.co - 1])), t -> named_struct(
                    't', t, 'least', IF(i >= {w - 1}, least(a.least, t), a.least),
                    'c', IF(z.o = z.n, a.c, transform(a.c, (c, k) -> c + IF(k = z.n, 1, IF(k = z.o, -1, 0))))))[0])[0])[0]"""
    start = f"named_struct('t', 0D, 'least', CAST({w} AS double) * 100, 'c', array_repeat(0, {len(SLOTS)}))"
    slots = f"transform(split({s}, ''), c -> instr('{SLOTS}', c) - 1)"
    fold = f"aggregate(sequence(0, size(x) - 1), {start}, (a, i) -> {step}, a -> log2({w}D) - a.least / {w})"
    return f"transform(array({slots}), x -> transform(array({g}), g -> {fold})[0])[0]"


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """All columns plus ``out``: array<struct<start,k,end,kind>> sorted by start, then kind.

    Positions are code points, the end is exclusive. Base kinds keep every match; entropy spans
    that base spans cover wholly are dropped, so they only add. A null text is empty and has none;
    a text of any length takes time in proportion to it; repeated rows give repeated results; an
    existing column of the output's name is replaced; names that start with ``_s_`` are internal.
    No shuffle: each row is scanned by itself, whole.
    """
    df = docs.drop(out).withColumn("_s_t", F.coalesce(F.col(text), F.lit("")))
    found = {}
    for kind, pattern, group, least in [*BASE, ("entropy", CANDIDATE, 1, WINDOW)]:
        none = F.array().cast("array<string>")
        seen = F.col("_s_t").rlike(pattern)
        df = df.withColumns({
            f"_s_{kind}_g": F.when(seen, F.split("_s_t", pattern, -1)).otherwise(none),
            f"_s_{kind}_h": F.when(seen, F.regexp_extract_all("_s_t", F.lit(pattern), F.lit(0))).otherwise(none),
        })
        value = f"_s_{kind}_h"
        if group == 2:
            value = f"_s_{kind}_v"
            df = df.withColumn(value, F.when(F.size(f"_s_{kind}_h") > 0, F.regexp_extract_all("_s_t", F.lit(pattern), F.lit(group))).otherwise(none))
        if kind == "entropy":
            def sql(s):
                return "r'" + s.replace("'", "\\'") + "'"

            least_h = "CASE " + " ".join(f"WHEN s RLIKE {sql(p)} THEN {h}D" for _, p, h in CLASSES) + " ELSE 99D END"
            allowed = " OR ".join(f"s RLIKE {sql(p)}" for p in ALLOW)
            df = df.withColumn(f"_s_{kind}_v", F.expr(f"transform({value}, s -> IF({allowed}, '', IF({window_entropy('s')} >= {least_h}, s, '')))"))
            value = f"_s_{kind}_v"
        found[kind] = _spans(kind, f"_s_{kind}_g", f"_s_{kind}_h", value, least)
    df = df.withColumns({f"_s_{k}": c for k, c in found.items()})
    base = F.concat(*(F.col(f"_s_{k}") for k, *_ in BASE))
    df = df.withColumn("_s_base", F.array_sort(base))
    # runs of base spans and entropy spans in one order, runs first: an entropy span is covered if the last run before it ends no earlier
    both = f"""array_sort(concat(transform({runs('_s_base', '<=')}, r -> named_struct('start', r.start, 'k', -1, 'end', r.end, 'kind', '')), _s_entropy))"""
    ends = prefixes("transform(e, s -> IF(s.k < 0, s.end, -1L))", "greatest({a}, {b})", "-1L")
    df = df.withColumn("_s_both", F.expr(f"IF(size(_s_entropy) = 0 OR size(_s_base) = 0, _s_entropy, {both})"))
    more = f"transform(array(_s_both), e -> transform(array({ends}), m -> filter(e, (s, i) -> s.k >= 0 AND m[i] < s.end))[0])[0]"
    df = df.withColumn("_s_more", F.expr(f"IF(size(_s_entropy) = 0 OR size(_s_base) = 0, _s_entropy, {more})"))
    df = df.withColumn(out, F.array_sort(F.concat("_s_base", "_s_more")))
    return df.drop(*(c for c in df.columns if c.startswith("_s_")))


def redact(docs: DataFrame, text: str = "text", spans: str = "secrets") -> DataFrame:
    """Replace each maximal run of overlapping spans by ``[REDACTED]``; a null text stays null.

    What is kept are the stretches between the runs, cut from pieces of the text, so that a long
    text with many spans is not walked from its start for each.
    """
    cut = f"""transform(array({runs(spans, '<')}), r -> transform(array(named_struct('p', regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0), 'n', cast(length({text}) AS bigint))), t -> array_join(zip_with(
        array_prepend(transform(r, x -> x.end), 0L), array_append(transform(r, x -> x.start), t.n), (a, b) ->
            IF(a >= b, '', array_join(transform(sequence(cast(a div {PIECE} AS int), cast((b - 1) div {PIECE} AS int)), k ->
                substring(t.p[k], cast(greatest(a - k * {PIECE}, 0) AS int) + 1, cast(least(b - k * {PIECE}, {PIECE}) - greatest(a - k * {PIECE}, 0) AS int))), ''))), '[REDACTED]'))[0])[0]"""
    return docs.withColumn(text, F.expr(f"IF({text} IS NULL OR size({spans}) = 0, {text}, {cut})"))


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans for every document."""
    df = find_secrets(docs.select("doc_id", "text"))
    shown = "concat_ws(',', transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    return df.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in ORDER),
        F.sha2(F.expr(shown.format("filter(secrets, s -> s.kind != 'entropy')")), 256).alias("base_sha256"),
        F.expr(shown.format("secrets")).alias("spans"),
    )


def oracle_sql() -> str:
    """The same in DuckDB SQL over whole texts."""
    def lit(s):
        return "'" + s.replace("'", "''") + "'"

    def starts(k):
        return f"list_sum(list_transform({k}_g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({k}_h[1:i-1], lambda x: length(x))), 0)"

    kinds = [*BASE, ("entropy", CANDIDATE, 1, WINDOW)]
    parts = ", ".join(f"string_split_regex(t, {lit(p)}) AS {k}_g, regexp_extract_all(t, {lit(p)}, 0) AS {k}_h, regexp_extract_all(t, {lit(p)}, {g}) AS {k}_v" for k, p, g, _ in kinds)
    least = "CASE " + " ".join(f"WHEN regexp_matches(x, {lit(p)}) THEN {h}" for _, p, h in CLASSES) + " ELSE 99 END"
    allowed = " OR ".join(f"regexp_matches(x, {lit(p.replace('++', '+'))})" for p in ALLOW)  # this engine has no possessive quantifiers and needs none
    high = f"list_max(list_transform(range(1, length(x) - {WINDOW} + 2), lambda i: list_aggregate(string_split(x[i:i+{WINDOW - 1}], ''), 'entropy'))) >= {least}"

    def spans(k, ok):
        n = ORDER.index(k)
        return f"list_transform(list_filter(range(1, len({k}_h) + 1), lambda i: {ok}), lambda i: {{'start': {starts(k)}, 'k': {n}, 'stop': {starts(k)} + length({k}_h[i]), 'kind': '{k}'}})"

    base = ", ".join(f"{spans(k, f'length({k}_v[i]) >= {n}')} AS {k}_s" for k, _, _, n in BASE)
    good = f"list_transform(entropy_v, lambda x: NOT ({allowed}) AND {high})"
    return f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, {parts} FROM a),
c AS (SELECT *, {good} AS entropy_ok FROM b),
d AS (SELECT doc_id, {base}, {spans('entropy', 'entropy_ok[i]')} AS entropy_s FROM c),
e AS (SELECT doc_id, list_concat(list_concat(assign_s, access_s), hex_s) AS base_s, assign_s, access_s, hex_s, entropy_s FROM d),
s AS (SELECT *, list_sort(base_s) AS b FROM e),
f AS (SELECT *, list_filter(entropy_s, lambda x: list_reduce(list_prepend(x.start, list_transform(b, lambda y: y.start * 1073741824 + y.stop)), lambda a, y: CASE WHEN y // 1073741824 <= a AND y % 1073741824 > a THEN y % 1073741824 ELSE a END) < x.stop) AS more_s FROM s)
SELECT doc_id, len(assign_s)::BIGINT AS n_assign, len(access_s)::BIGINT AS n_access, len(hex_s)::BIGINT AS n_hex, len(more_s)::BIGINT AS n_entropy,
sha256(array_to_string(list_transform(list_sort(base_s), lambda x: x.kind || ':' || x.start || ':' || x.stop), ',')) AS base_sha256,
array_to_string(list_transform(list_sort(list_concat(base_s, more_s)), lambda x: x.kind || ':' || x.start || ':' || x.stop), ',') AS spans FROM f"""

"""Secret scan: known formats, and a randomness test battery for the rest.

Base spans are the matches of three patterns. Beside them every long run of
token characters is tested. Its encoding is inferred from its characters (the
first of hex, base 32, lower-case alphanumeric, alphanumeric and base 64 that
holds them all), and its symbols' places in that alphabet go through three
tests of uniform randomness:

* chi-squared uniformity of the alphabet (Wilson-Hilferty's normal form),
* the runs test around the alphabet's middle,
* lag-one serial correlation with the alphabet's known mean and variance.

The battery's p-value is three times the smallest one, 1 at most. A token is
dismissed as structured when its p-value is small enough by the
Benjamini-Hochberg rule, applied within each (encoding, length band), so that
short tokens, on which the tests have little power, don't borrow the
threshold of long ones: of the dismissed tokens a share of ``alpha`` at most
is random in expectation. What is not dismissed is reported as ``random`` if
it also mixes digits and letters and overlaps no base span.

Only SQL functions are used and every row stays in its place; the only
aggregation counts p-values on a fixed grid per stratum, and its thresholds,
at most one for each stratum, become literals of the final projection.

Defined results: a null or empty text has no spans; spans are in code points,
end exclusive; repeated rows are scanned each; extra columns are ignored; an
empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs are maximal, so a least length inside the pattern drops the same matches as a later filter.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: (name, pattern of the token without padding, alphabet)
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", LOWER.upper() + "234567"),
    ("alnum36", "^[a-z0-9]+$", DIGITS + LOWER),
    ("alnum62", "^[A-Za-z0-9]+$", LOWER.upper() + LOWER + DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", LOWER.upper() + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", LOWER.upper() + LOWER + DIGITS + "-_"),
)
SPANS = "array<struct<start: int, kind: int, end: int, token: string>>"
RUN = 64
GRID = 20  # steps of the p-value's decimal logarithm
GRID_END = 300 * GRID


def placed(text: Column, pattern: str, name: int) -> Column:
    """Matches as array<struct<start, kind, end, token>>: what split() leaves between them tells their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(found: Column, between: Column) -> Column:
        lengths = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"), m.alias("token")))
        none = F.expr(f"cast(array() as {SPANS})")

        def run(at: Column, some: Column) -> Column:
            """struct<at, out>: where these matches end, and their places, given where they begin."""
            step = lambda a, x: F.struct((a.at + x.b + x.m).alias("at"), F.concat(a.out, F.array(F.struct((a.at + x.b).alias("start"), F.lit(name).alias("kind"), (a.at + x.b + x.m).alias("end"), x.token.alias("token")))).alias("out"))
            return F.aggregate(some, F.struct(at.alias("at"), none.alias("out")), step)

        def place(all_: Column) -> Column:
            # An array grows by copying, so many matches are placed in runs and the runs joined.
            joined = F.aggregate(
                runs_of(all_, F.lit(RUN)),
                F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPANS}>)").alias("out")),
                lambda a, some: F.struct((a.at + F.aggregate(some, F.lit(0), lambda n, x: n + x.b + x.m)).alias("at"), F.concat(a.out, F.array(run(a.at, some).getField("out"))).alias("out")),
                lambda a: F.flatten(a.out),
            )
            return F.when(F.size(all_) <= RUN, run(F.lit(0), all_).getField("out")).otherwise(joined)

        return once(lengths, place)

    return F.when(F.size(found) > 0, spans(found, F.split(text, pattern, -1))).otherwise(F.expr(f"cast(array() as {SPANS})"))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value): a lambda's variable is evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def runs_of(spans: Column, size: Column) -> Column:
    """A sorted array of spans in pieces of some size."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / size).cast("int")), lambda i: F.slice(spans, i * size + 1, size))


def apart(tokens: Column, base: Column) -> Column:
    """Tokens that overlap no base span. Many base spans are looked up by the hulls of their runs."""
    meets = lambda t, b: (b.start < t.end) & (t.start < b.end)
    few = F.filter(tokens, lambda t: ~F.exists(base, lambda b: meets(t, b)))
    hulls = F.transform(runs_of(base, F.ceil(F.sqrt(F.size(base))).cast("int")), lambda r: F.struct(F.element_at(r, 1).start.alias("start"), F.array_max(F.transform(r, lambda b: b.end)).alias("end"), r.alias("spans")))
    many = once(hulls, lambda h: F.filter(tokens, lambda t: ~F.exists(h, lambda r: meets(t, r) & F.exists(r.spans, lambda b: meets(t, b)))))
    return F.when(F.size(base) <= RUN, few).otherwise(many)


def tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution, within a few per cent everywhere."""
    core = 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))
    far = F.exp(-z * z / 2) / (z * 2.5066282746 * (1 + 1 / (z * z)))
    return F.when(z > 3, far).otherwise(core)


def tested(span: Column) -> Column:
    """struct<start, end, encoding, n, p> of a token; encoding is null where no alphabet holds it or it lacks digits or letters."""
    bare = F.regexp_replace(span.token, "=+$", "")
    encoding = F.lit(None).cast("int")
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        encoding = F.when(bare.rlike(pattern), F.lit(i)).otherwise(encoding)
    mixed = bare.rlike("[0-9]") & bare.rlike("[A-Za-z]")
    return F.struct(span.start.alias("start"), span.end.alias("end"), F.when(mixed, encoding).alias("encoding"), F.length(bare).alias("n"), bare.alias("token"))


def battery(t: Column) -> Column:
    """The battery's p-value for a struct of tested()."""
    alphabet = F.element_at(F.array(*(F.lit(a) for _, _, a in ENCODINGS)), t.encoding + 1)
    token = F.when(t.encoding == 0, F.lower(t.token)).otherwise(t.token)
    places = F.transform(F.split(token, ""), lambda x: F.instr(alphabet, x) - 1)
    return F.aggregate(F.array(F.struct(places.alias("x"), F.length(alphabet).cast("double").alias("q"), t.n.cast("double").alias("n"))), F.lit(0.0), lambda _, s: _p_value(s.x, s.q, s.n))


def _p_value(x: Column, q: Column, n: Column) -> Column:
    zero = F.lit(0.0)
    squares = F.aggregate(F.array_distinct(x), zero, lambda a, v: a + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)))
    chi = q / n * squares - n
    df = q - 1
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    high = F.transform(x, lambda v: (v >= q / 2).cast("int"))
    n1 = F.aggregate(high, zero, lambda a, v: a + v)
    pairs = F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x) - 1).alias("b"))
    changes = F.aggregate(pairs, zero, lambda a, v: a + ((v.a >= q / 2) != (v.b >= q / 2)).cast("double"))
    both = 2 * n1 * (n - n1)
    spread = both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(spread > 0, F.abs(changes - both / n) / F.sqrt(spread)).otherwise(F.lit(9.0))
    mean, variance = (q - 1) / 2, (q * q - 1) / 12
    z_serial = F.abs(F.aggregate(pairs, zero, lambda a, v: a + (v.a - mean) * (v.b - mean))) / variance / F.sqrt(n - 1)
    return F.least(F.lit(1.0), 3 * F.least(tail(z_chi), 2 * tail(z_runs), 2 * tail(z_serial)))


def scan(docs: DataFrame, *, alpha: float = 0.05, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per document: doc_id, _base and found (array<struct<start, kind, end>> by start, then kind; found holds all spans), and with carry the row as _row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.struct("*").alias("_row")] if carry else []
    kept = ["_row"] if carry else []
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row, text.alias("_text"))
    d = d.select("doc_id", *kept, placed(F.col("_text"), ASSIGN, 0).alias("_assign"), placed(F.col("_text"), ACCESS, 1).alias("_access"), placed(F.col("_text"), HEX, 2).alias("_hex"), placed(F.col("_text"), TOKEN, 3).alias("_token"))
    value = lambda s: F.length(F.regexp_extract(s.token, ASSIGN, 2)) >= 6
    plain = lambda c: F.transform(c, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    d = d.select("doc_id", *kept, F.array_sort(F.concat(plain(F.filter("_assign", value)), plain(F.col("_access")), plain(F.col("_hex")))).alias("_base"), F.filter(F.transform("_token", tested), lambda t: t.encoding.isNotNull()).alias("_tested"))
    d = d.withColumn("_tested", apart(F.col("_tested"), F.col("_base")))
    judged = lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), (t.encoding * 64 + F.floor(F.log2(t.n.cast("double"))).cast("int")).alias("stratum"), F.least(F.lit(GRID_END), F.floor(-GRID * F.log10(battery(t) + F.lit(1e-300)))).cast("int").alias("grid"))
    d = keep(d.withColumn("_tested", F.transform("_tested", judged)), "secrets")
    counts = d.select(F.explode("_tested").alias("t")).groupBy("t.stratum", "t.grid").agg(F.count(F.lit(1)).alias("n"))
    limits = dismissals(counts, alpha)
    # A token's grid step says that its p-value is at most 10 ** (-grid / GRID).
    least = lambda t: F.coalesce(F.try_element_at(limits, t.stratum), F.lit(GRID_END + 1))
    spared = F.filter("_tested", lambda t: t.grid < least(t))
    extra = F.transform(spared, lambda t: F.struct(t.start.alias("start"), F.lit(3).alias("kind"), t.end.alias("end")))
    return d.select("doc_id", *kept, "_base", F.array_sort(F.concat("_base", extra)).alias("found"))


def dismissals(counts: DataFrame, alpha: float) -> Column:
    """Map literal from a stratum to the least grid step that the Benjamini-Hochberg rule dismisses; counts: stratum, grid, n."""
    stratum = Window.partitionBy("stratum")
    ranked = counts.select("stratum", "grid", F.sum("n").over(stratum).alias("m"), F.sum("n").over(stratum.orderBy(F.desc("grid"))).alias("k"))
    fit = ranked.filter(F.pow(F.lit(10.0), -F.col("grid") / GRID) <= alpha * F.col("k") / F.col("m"))
    rows = fit.groupBy("stratum").agg(F.min("grid").alias("grid")).collect()
    if not rows:
        return F.expr("cast(map() as map<int, int>)")
    return F.create_map(*(F.lit(int(v)) for r in rows for v in (r.stratum, r.grid)))


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Per document: counts of base spans, the hash of their names, and all spans' names."""
    count = lambda k: F.size(F.filter("_base", lambda s: s.kind == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(named(F.col("_base")), 256).alias("base_sha256"), named(F.col("found")).alias("spans"))


def covered(text: Column, spans: Column, mark: str) -> Column:
    """text with a mark for each group of overlapping spans (sorted). Runs of spans are cut from a piece of text each, so many spans cost no more than a few passes over the text."""

    def run(piece: Column, at: Column, some: Column) -> Column:
        """The piece of text from at to the last end of some spans, covered."""
        step = lambda a, s: F.when(s.start >= a.at, F.struct(F.concat(a.out, F.substring(piece, a.at - at + 1, s.start - a.at), F.lit(mark)).alias("out"), s.end.alias("at"))).otherwise(F.struct(a.out.alias("out"), F.greatest(a.at, s.end).alias("at")))
        return F.aggregate(some, F.struct(F.lit("").alias("out"), at.alias("at")), step, lambda a: a.out)

    def step(a: Column, some: Column) -> Column:
        end = F.greatest(a.at, F.array_max(F.transform(some, lambda s: s.end)))
        return F.struct(F.concat(a.out, F.array(once(F.substring(text, a.at + 1, end - a.at), lambda piece: run(piece, a.at, some)))).alias("out"), end.alias("at"))

    begin = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(runs_of(spans, F.lit(RUN)), begin, step, lambda a: F.concat(F.array_join(a.out, ""), F.substring(text, a.at + 1, F.length(text))))


def redact(docs: DataFrame, *, mark: str = "[SECRET]", text_col: str = "text", **options) -> DataFrame:
    """docs with every span of text_col replaced by a mark; overlapping spans share one. Other columns and other rows stay as they are."""
    found = scan(docs, text_col=text_col, carry=True, **options)
    text = F.col("_row").getField(text_col).cast("string")
    clean = F.when(F.size("found") > 0, once(text, lambda t: covered(t, F.col("found"), mark))).otherwise(text)
    done = found.select("_row", clean.alias("_clean"))  # apart from the given names, which may be any
    return done.select(*((F.col("_clean") if n == text_col else F.col("_row").getField(n)).alias(n) for n in docs.columns))


def sql(alpha: float = 0.05) -> str:
    """digest(scan(documents)) as DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    assign = quoted(ASSIGN.replace(r"\"", '"').replace(r"\'", "'"))

    def spans(kind: int, pattern: str) -> str:
        return f"""SELECT id, {kind} AS kind, m[k] AS token, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT id, m, p, unnest(range(1, len(m) + 1)) AS k FROM (SELECT id, regexp_extract_all(t, {pattern}) AS m, regexp_split_to_array(t, {pattern}) AS p FROM d))"""

    encoding = "CASE " + " ".join(f"WHEN regexp_matches(bare, {quoted(p)}) THEN {i}" for i, (_, p, _) in enumerate(ENCODINGS)) + " END"
    alphabet = "CASE encoding " + " ".join(f"WHEN {i} THEN {quoted(a)}" for i, (_, _, a) in enumerate(ENCODINGS)) + " END"
    tail = lambda z: f"(CASE WHEN {z} > 3 THEN exp(-{z} * {z} / 2) / ({z} * 2.5066282746 * (1 + 1 / ({z} * {z}))) ELSE 1 / (1 + exp(1.5976 * {z} + 0.07056 * {z} * {z} * {z})) END)"
    kinds = "[" + ", ".join(map(quoted, KINDS)) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
  b AS (SELECT id, kind, start, start + length(token) AS stop FROM (
    {spans(0, assign)} UNION ALL {spans(1, quoted(ACCESS))} UNION ALL {spans(2, quoted(HEX))}) WHERE kind <> 0 OR length(regexp_extract(token, {assign}, 2)) >= 6),
  c AS (SELECT id, start, start + length(token) AS stop, regexp_replace(token, '=+$', '') AS bare FROM ({spans(3, quoted(TOKEN))})),
  e AS (SELECT *, {encoding} AS encoding FROM c WHERE regexp_matches(bare, '[0-9]') AND regexp_matches(bare, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.id = c.id AND b.start < c.stop AND c.start < b.stop)),
  a AS (SELECT *, {alphabet} AS alphabet, CASE WHEN encoding = 0 THEN lower(bare) ELSE bare END AS s FROM e WHERE encoding IS NOT NULL),
  x AS (SELECT *, length(alphabet)::DOUBLE AS q, length(bare)::DOUBLE AS n, list_transform(string_split(s, ''), lambda v: instr(alphabet, v) - 1) AS x FROM a),
  y AS (SELECT *, q / n * list_sum(list_transform(list_distinct(x), lambda v: pow(len(list_filter(x, lambda u: u = v)), 2))) - n AS chi, len(list_filter(x, lambda v: v >= q / 2))::DOUBLE AS n1, list_zip(x[1:len(x) - 1], x[2:]) AS pairs FROM x),
  z AS (SELECT *, (pow(chi / (q - 1), {1 / 3!r}) - (1 - 2 / (9 * (q - 1)))) / sqrt(2 / (9 * (q - 1))) AS z_chi, 2 * n1 * (n - n1) AS both_, len(list_filter(pairs, lambda v: (v[1] >= q / 2) <> (v[2] >= q / 2)))::DOUBLE AS changes,
    abs(list_sum(list_transform(pairs, lambda v: (v[1] - (q - 1) / 2) * (v[2] - (q - 1) / 2)))) / ((q * q - 1) / 12) / sqrt(n - 1) AS z_serial FROM y),
  r AS (SELECT *, both_ * (both_ - n) / (n * n * (n - 1)) AS spread FROM z),
  u AS (SELECT *, CASE WHEN spread > 0 THEN abs(changes - both_ / n) / sqrt(spread) ELSE 9.0 END AS z_runs FROM r),
  g AS (SELECT id, start, stop, encoding * 64 + floor(log2(n))::INT AS stratum, least({GRID_END}, floor(-{GRID} * log10(least(1.0, 3 * least({tail('z_chi')}, 2 * {tail('z_runs')}, 2 * {tail('z_serial')})) + 1e-300)))::INT AS grid FROM u),
  h AS (SELECT stratum, grid, count(*) AS n FROM g GROUP BY ALL),
  k AS (SELECT stratum, grid, sum(n) OVER (PARTITION BY stratum) AS m, sum(n) OVER (PARTITION BY stratum ORDER BY grid DESC) AS k FROM h),
  l AS (SELECT stratum, min(grid) AS least_grid FROM k WHERE pow(10.0, -grid / {GRID}.0) <= {alpha} * k / m GROUP BY stratum),
  f AS (SELECT id, kind, start, stop FROM b UNION ALL SELECT id, 3, start, stop FROM g LEFT JOIN l USING (stratum) WHERE grid < coalesce(least_grid, {GRID_END + 1})),
  o AS (SELECT id, kind, start, stop, concat_ws(':', {kinds}[kind + 1], start::BIGINT, stop::BIGINT) AS name FROM f),
  t AS (SELECT id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg(name, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind, stop) AS spans FROM o GROUP BY id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (id)"""

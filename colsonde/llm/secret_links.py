"""Secret scans with linking of credential parts; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colsonde.llm import common


def _either_case(*words: str) -> str:
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


# Patterns of the base kinds and of the parts that are linked.
_KEYS = ("password", "passwd", "secret", "token", "api_?key")
_NAMES = ("client_id", "access_id", "user_id", "username", "account", "login")
_GLUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"({_either_case(*_KEYS)}){_GLUE}([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
NAMED = rf"({_either_case(*_NAMES)}){_GLUE}([A-Za-z0-9_.@-]+)"
ENDPOINT = r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"

KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
#: Code points between the starts of parts that belong to one scope.
REACH = 200

def _steps(text: Column, pattern: str, may: Column, value: bool = False) -> Column:
    """Leftmost non-overlapping matches: array of (gap before, length, length of group 2), null if there are none.

    ``may`` is a cheaper condition that any match needs; most texts end there or at the first search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    inner = lambda m: F.char_length(F.regexp_extract(m, pattern, 2)) if value else F.lit(0)
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("l"), inner(m).alias("v")))
    return F.when(may & text.rlike(pattern), steps)


def find_steps(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` without the text but with __row, unique once this is settled, and the matches of each pattern."""
    text, low = F.col("__text"), F.col("__low")
    out = docs.withColumn("__text", common.text_of(column)).withColumn("__low", F.lower("__text"))
    any_of = lambda *words: F.lit(False) if not words else low.contains(words[0]) | any_of(*words[1:])
    return out.select(
        *[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c != column],
        F.monotonically_increasing_id().alias("__row"),
        _steps(text, ASSIGN, any_of("password", "passwd", "secret", "token", "api"), True).alias("__assign"),
        _steps(text, ACCESS, text.contains("AKIA")).alias("__access"),
        _steps(text, HEX, F.lit(True)).alias("__hex"),
        _steps(text, NAMED, any_of(*_NAMES), True).alias("__named"),
        _steps(text, ENDPOINT, text.contains("://")).alias("__url"),
    )


def find_parts(found: DataFrame) -> DataFrame:
    """(__row, s, k, e) of every part, k a place in KINDS, in code points.

    ``weak_secret``: assignments of 6 to 11 characters; ``weak_id``: access identifiers of 8 to
    17 characters and named identifiers of 3 or more; ``endpoint``: URLs. Matches of a text
    are placed by running sums over them, in time linear in their number.
    """
    sources = ("__assign", "__access", "__hex", "__named", "__url")
    some = found.where(" OR ".join(f"{c} IS NOT NULL" for c in sources))

    def numbered(n: int, source: str) -> Column:
        one = lambda x, i: F.struct(F.lit(n).alias("of"), i.alias("i"), x["g"].alias("g"), x["l"].alias("l"), x["v"].alias("v"))
        return F.coalesce(F.transform(source, one), F.array())

    steps = F.flatten(F.array(*[numbered(n, c) for n, c in enumerate(sources)]))
    each = some.select("__row", F.explode(steps).alias("x")).select("__row", "x.*")
    upto = Window.partitionBy("__row", "of").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("g") + F.col("l")).cast("bigint")).over(upto)
    kind = lambda name: F.lit(KINDS.index(name))
    k = (
        F.when(F.col("of") == 0, F.when(F.col("v") >= 12, kind("assign")).when(F.col("v") >= 6, kind("weak_secret")))
        .when(F.col("of") == 1, F.when(F.col("l") >= 18, kind("access")).when(F.col("l") >= 8, kind("weak_id")))
        .when(F.col("of") == 2, kind("hex"))
        .when(F.col("of") == 3, F.when(F.col("v") >= 3, kind("weak_id")))
        .otherwise(kind("endpoint"))
    )
    return each.withColumn("e", end).withColumn("k", k).where("k IS NOT NULL").select("__row", (F.col("e") - F.col("l")).alias("s"), "k", "e")


def link(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts whose complementary parts start within ``reach`` code points.

    An interval join by equal blocks of ``reach`` code points: each weak span looks into its own
    block and both neighbours, where each part role is summed up by its least and largest
    start, so a text of many parts makes three rows a span and never pairs. Exact, as all of
    its own block is in reach and the nearest start in a neighbour is its least or largest.
    """
    k = lambda name: KINDS.index(name)
    parts = parts.withColumn("block", F.floor(F.col("s") / reach))
    role = (
        F.when(F.col("k").isin(k("access"), k("weak_id")), "id")
        .when(F.col("k").isin(k("assign"), k("hex"), k("weak_secret")), "secret")
    )
    sums = parts.withColumn("role", role).where("role IS NOT NULL").groupBy("__row", "block", "role").agg(F.min("s").alias("least"), F.max("s").alias("most"))
    probes = parts.where(F.col("k") >= k("weak_secret")).withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    near = (F.abs(F.col("least") - F.col("s")) <= reach) | (F.abs(F.col("most") - F.col("s")) <= reach)
    has = lambda r: F.coalesce(F.max(F.when(near & (F.col("role") == r), F.lit(True))), F.lit(False))
    seen = probes.join(sums, ["__row", "block"]).groupBy("__row", "s", "k", "e").agg(has("id").alias("id"), has("secret").alias("secret"))
    whole = (
        ((F.col("k") == k("weak_secret")) & F.col("id"))
        | ((F.col("k") == k("weak_id")) & F.col("secret"))
        | ((F.col("k") == k("endpoint")) & F.col("id") & F.col("secret"))
    )
    return seen.where(whole).select("__row", "s", "k", "e")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, column: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` without the text but with n_assign, n_access, n_hex, base_spans and spans.

    Base kinds as their patterns say, leftmost and non-overlapping per kind; then weak spans
    whose complementary parts start within ``reach`` code points, their scope: a weak secret beside an
    identifier, a weak identifier beside a secret, an endpoint beside both. Spans are
    ``kind:start:end`` (code points, end exclusive) by start, then kind, comma-joined. Null and
    empty texts have none; repeated rows get the same spans each. Columns of these names are
    replaced, and names that begin with __ are this operator's own. Texts are read once; only
    matches are dealt by text and placed, so a text of very many costs a sort of them.
    """
    docs = docs.drop("n_assign", "n_access", "n_hex", "base_spans", "spans")
    found = common.settle(find_steps(docs, column), "secret-steps")
    parts = common.settle(find_parts(found), "secret-parts")
    weak = KINDS.index("weak_secret")
    every = parts.where(F.col("k") < weak).unionByName(link(parts, reach))
    spans = F.sort_array(F.collect_list(F.struct("s", "k", "e")))
    joined = found.join(every.groupBy("__row").agg(spans.alias("__spans")), "__row", "left")
    listed = F.coalesce("__spans", F.array().cast("array<struct<s:bigint,k:int,e:bigint>>"))
    count = lambda name: F.size(F.filter(listed, lambda x: x["k"] == KINDS.index(name))).cast("bigint")
    return joined.select(
        *[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c != column],
        count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        _listed(F.filter(listed, lambda x: x["k"] < weak)).alias("base_spans"), _listed(listed).alias("spans"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = scan_secrets(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def _sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"

    def one(kind: str, pattern: str, keep: str) -> str:
        p = quote(pattern)
        return (
            f"SELECT doc_id, {KINDS.index(kind)} AS k, s, s + length(m) AS e FROM ("
            f"SELECT doc_id, m[i] AS m, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM ("
            f"SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM ("
            f"SELECT doc_id, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM d WHERE regexp_matches(t, {p})))) WHERE {keep}"
        )

    value = lambda p: f"length(regexp_extract(m, {quote(p)}, 2))"
    parts = " UNION ALL ".join([
        one("assign", ASSIGN, value(ASSIGN) + " >= 12"),
        one("access", ACCESS, "length(m) >= 18"),
        one("hex", HEX, "true"),
        one("weak_secret", ASSIGN, value(ASSIGN) + " BETWEEN 6 AND 11"),
        one("weak_id", ACCESS, "length(m) BETWEEN 8 AND 17"),
        one("weak_id", NAMED, value(NAMED) + " >= 3"),
        one("endpoint", ENDPOINT, "true"),
    ])
    near = lambda kinds: f"EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = p.doc_id AND o.k IN {kinds} AND abs(o.s - p.s) <= {REACH})"
    names = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
    one_span = f"(CASE k {names} END) || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, k, s::BIGINT AS s, e::BIGINT AS e FROM ({parts})),
good AS (
  SELECT * FROM parts p WHERE k < 3 OR (k = 3 AND {near("(1, 4)")}) OR (k = 4 AND {near("(0, 2, 3)")})
    OR (k = 5 AND {near("(1, 4)")} AND {near("(0, 2, 3)")}))
SELECT d.doc_id, (count(*) FILTER (k = 0))::BIGINT AS n_assign, (count(*) FILTER (k = 1))::BIGINT AS n_access, (count(*) FILTER (k = 2))::BIGINT AS n_hex,
       sha256(coalesce(string_agg({one_span}, ',' ORDER BY s, k, e) FILTER (k < 3), '')) AS base_sha256,
       coalesce(string_agg({one_span}, ',' ORDER BY s, k, e) FILTER (k IS NOT NULL), '') AS spans
FROM d LEFT JOIN good ON d.doc_id = good.doc_id GROUP BY d.doc_id
"""


SQL = _sql()

"""Queries over the star-schema tables, one per operator, and the same in plain SQL.

The tables hold no listings, so each query derives its input from them by a fixed rule and then applies the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline import constants as K
from tallyline.functions.initials import initials_score, initials_state
from tallyline.functions.similarity import edit_ratio, text_similarity
from tallyline.functions.text import case_key, dates_iso, highlight_spans, is_noise, name_parts, skeleton
from tallyline.functions.tiers import classify, noisy_or, register_age, tier_of
from tallyline.operators._common import least_by
from tallyline.operators.layout import clusters
from tallyline.operators.linking import link_names, name_windows
from tallyline.operators.ranges import expand_case_cells
from tallyline.operators.views import item_order
from tallyline.plans import name_sql as N

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def perturbed_names(parts: DataFrame) -> DataFrame:
    """p_partkey, p_brand, printed: an initial from the key, and one of six changes to the name."""
    words = F.split(F.upper("p_name"), " ")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    initial = F.char(F.lit(65) + F.col("p_partkey") % 26)
    kind = F.col("p_partkey") % 6
    name = (
        F.when(kind == 0, F.concat(initial, F.lit("."), F.upper("p_name")))
        .when(kind == 1, F.upper("p_name"))
        .when(kind == 2, F.concat(F.char(F.lit(65) + (F.col("p_partkey") + 7) % 26), F.lit("."), F.upper("p_name")))
        .when(kind == 3, F.concat(second, F.lit(" "), initial, F.lit("."), first))
        .when(kind == 4, F.concat(initial, F.lit("."), F.replace(F.replace(F.upper("p_name"), F.lit("E"), F.lit("EE")), F.lit("U"), F.lit("OO"))))
        .otherwise(F.concat(initial, F.lit("."), first, second))
    )
    return parts.select("p_partkey", "p_brand", name.alias("printed"))


PRINTED = """SELECT p_partkey, p_brand, p_size, CASE p_partkey % 6 WHEN 0 THEN i || '.' || u WHEN 1 THEN u WHEN 2 THEN chr(65 + ((p_partkey + 7) % 26)::INTEGER) || '.' || u
  WHEN 3 THEN w[2] || ' ' || i || '.' || w[1] WHEN 4 THEN i || '.' || replace(replace(u, 'E', 'EE'), 'U', 'OO') ELSE i || '.' || w[1] || w[2] END AS name
  FROM (SELECT *, chr(65 + (p_partkey % 26)::INTEGER) AS i, upper(p_name) AS u, string_split(upper(p_name), ' ') AS w FROM part)"""
ROSTER = """SELECT k AS advocate_ord, chr(65 + (k % 26)::INTEGER) || '. ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name
  FROM (SELECT p_name, row_number() OVER (ORDER BY encode(p_name)) - 1 AS k FROM (SELECT DISTINCT p_name FROM part))"""


def part_roster(parts: DataFrame) -> DataFrame:
    """A roster of all names in order of code point, with an initial by their place."""
    names = parts.select("p_name").distinct()
    names = names.withColumn("advocate_ord", F.row_number().over(Window.orderBy("p_name")) - 1)
    return names.select("advocate_ord", F.concat(F.char(F.lit(65) + F.col("advocate_ord") % 26), F.lit(". "), F.initcap("p_name")).alias("name"))


@query(f"""
WITH {N.scores(f"SELECT name FROM ({ROSTER})", f"SELECT name FROM ({PRINTED})")},
hits AS (SELECT q_name, p_brand, p_partkey, c_name, round(core, 9) AS core, round(combined, 9) AS combined, state, {N.rank("core", "combined", "state", "false")} AS rank FROM ({PRINTED}) p JOIN scored ON p.name = c_name),
best AS (SELECT *, row_number() OVER (PARTITION BY q_name, p_brand ORDER BY combined DESC, p_partkey) AS n FROM hits WHERE rank > 0)
SELECT q_name AS advocate, p_brand, p_partkey, c_name AS printed, core, combined, state, ['none', 'weak', 'review', 'auto'][rank + 1] AS tier FROM best WHERE n = 1
""")
def roster_match(spark: SparkSession, sf: str) -> DataFrame:
    """For each roster name and brand the best printed name, with its tier."""
    parts = t(spark, sf, "part", "p_partkey", "p_name", "p_brand")
    roster, printed = part_roster(parts), perturbed_names(parts)
    links = link_names(roster, printed.select(F.col("printed").alias("name"))).withColumns({"core": F.round("core", 9), "combined": F.round("combined", 9)})
    hits = printed.join(links, F.col("printed") == F.col("c_name"))
    best = least_by(hits.withColumn("_d", -F.col("combined")), ["q_name", "p_brand"], ["_d", "p_partkey"], ["p_partkey", "printed", "core", "combined", "state", "tier_rank"], "h")
    return best.select(F.col("q_name").alias("advocate"), "p_brand", "h.p_partkey", "h.printed", "h.core", "h.combined", "h.state", tier_of(F.col("h.tier_rank")).alias("tier"))


_NAME = "chr(65 + (p_partkey % 26)::INTEGER) || '. ' || upper(p_name) || CASE WHEN p_partkey % 3 = 0 THEN ' AND OTHERS' ELSE '' END"
_WORDS = lambda words: "|".join(words)


@query(f"""
WITH n AS (SELECT p_partkey, 'Thiru. ' || {_NAME} AS s FROM part),
a AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(upper(s), '\\b({_WORDS(K.TITLES)})\\b', ' ', 'g'), '\\b({_WORDS(K.ROLES)})\\b', ' ', 'g'), '\\b({_WORDS(K.PARTY_SEPARATORS)})\\b', ' ', 'g') AS s FROM n),
b AS (SELECT p_partkey, list_filter(regexp_split_to_array(regexp_replace(s, '[^A-Z. ]', ' ', 'g'), '[.\\s]+'), lambda x: x <> '') AS k FROM a)
SELECT p_partkey, array_to_string(list_filter(k, lambda x: length(x) = 1), ' ') AS initials, array_to_string(list_filter(k, lambda x: length(x) > 1), ' ') AS core FROM b
""")
def name_split(spark: SparkSession, sf: str) -> DataFrame:
    """Initials and core of names with salutations and party words."""
    name = F.concat(F.lit("Thiru. "), F.char(F.lit(65) + F.col("p_partkey") % 26), F.lit(". "), F.upper("p_name"), F.when(F.col("p_partkey") % 3 == 0, " AND OTHERS").otherwise(""))
    out = t(spark, sf, "part", "p_partkey", "p_name").withColumn("n", name_parts(name))
    return out.select("p_partkey", F.array_join("n.initials", " ").alias("initials"), F.array_join("n.core", " ").alias("core"))


def _folded(column: str) -> str:
    for a, b in K.SKELETON_RULES:
        column = f"replace({column}, '{a}', '{b}')"
    return column


@query(f"""
WITH w AS (SELECT p_partkey, {_folded("regexp_replace(upper(p_name), '[^A-Z]', '', 'g')")} AS s FROM part),
c AS (SELECT p_partkey, s, string_split(s, '') AS k FROM w)
SELECT p_partkey, regexp_replace(array_to_string(list_transform(list_filter(range(1, len(k) + 1), lambda i: i = 1 OR k[i] <> k[i - 1]), lambda i: k[i]), ''), '[AEIOU]', '', 'g') AS skeleton FROM c
""")
def indic_fold(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part", "p_partkey", "p_name").select("p_partkey", skeleton(F.col("p_name")).alias("skeleton"))


@query("""
WITH n AS (SELECT DISTINCT p_brand, upper(p_name) AS name FROM part)
SELECT a.p_brand, a.name AS a, b.name AS b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 9) AS ratio
FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.name < b.name
""")
def edit_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Edit ratio of the distinct names within a brand, of which there are few."""
    n = t(spark, sf, "part", "p_brand", "p_name").select("p_brand", F.upper("p_name").alias("a")).distinct()
    pairs = n.join(n.withColumnRenamed("a", "b"), "p_brand").filter("a < b")
    return pairs.select("p_brand", "a", "b", F.round(edit_ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


@query(f"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, unnest(string_split(name, ' ')) AS word FROM n),
p AS (SELECT DISTINCT x.name AS a, y.name AS b FROM w x JOIN w y ON x.word = y.word AND x.name < y.name),
{N.texts("SELECT a, b FROM p", "sim")}
SELECT a, b, round(sim, 9) AS similarity FROM sim
""")
def text_similarities(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of the distinct part names that share a word."""
    w = t(spark, sf, "part", "p_name").distinct().select(F.col("p_name").alias("a"), F.explode(F.split("p_name", " ")).alias("word"))
    pairs = w.join(w.withColumnRenamed("a", "b"), "word").filter("a < b").select("a", "b").distinct()
    return pairs.withColumn("similarity", F.round(text_similarity(F.col("a"), F.col("b")), 9))


_LETTERS = lambda a, b, c: f"CASE WHEN o_orderkey % 7 = {c} THEN '' ELSE chr(65 + ({a})::INTEGER) || CASE WHEN o_orderkey % 3 = 0 THEN chr(65 + ({b})::INTEGER) ELSE '' END END"


@query(f"""
WITH l AS (SELECT o_orderkey, {_LETTERS("o_orderkey % 26", "o_custkey % 26", 0)} AS q, {_LETTERS("o_custkey % 26", "o_orderkey % 26", 1)} AS c FROM orders),
s AS (SELECT *, {N.initials_case()} AS state FROM l)
SELECT o_orderkey, q, c, state, CASE state {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in K.INITIALS_SCORES.items())} END AS score FROM s
""")
def initials_states(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders", "o_orderkey", "o_custkey")
    letter = lambda c: F.char(F.lit(65) + F.col(c) % 26)
    made = lambda a, b, n: F.when(F.col("o_orderkey") % 7 == n, "").otherwise(F.concat(letter(a), F.when(F.col("o_orderkey") % 3 == 0, letter(b)).otherwise("")))
    out = o.select("o_orderkey", made("o_orderkey", "o_custkey", 0).alias("q"), made("o_custkey", "o_orderkey", 1).alias("c")).withColumn("state", initials_state(F.col("q"), F.col("c")))
    return out.withColumn("score", initials_score(F.col("state")))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, 0.5 + l_discount * 5 AS core, (0.5 + l_discount * 5) * (0.62 + 0.38 * (1 - l_tax * 4)) AS combined,
  CASE WHEN l_returnflag = 'A' THEN 'exact' WHEN l_returnflag = 'R' THEN 'partial' ELSE 'subset' END AS state, l_linestatus = 'O' AS ocr FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN core < CASE WHEN ocr THEN 0.66::DOUBLE ELSE 0.72::DOUBLE END THEN 'none'
  WHEN combined >= 0.86::DOUBLE - CASE WHEN ocr THEN 0.04::DOUBLE ELSE 0 END AND state IN ('exact', 'partial') THEN 'auto'
  WHEN combined >= 0.68::DOUBLE - CASE WHEN ocr THEN 0.04::DOUBLE ELSE 0 END THEN 'review'
  WHEN combined >= 0.58::DOUBLE - CASE WHEN ocr THEN 0.04::DOUBLE ELSE 0 END THEN 'weak' ELSE 'none' END AS tier FROM s
""")
def tiering(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    core = F.lit(0.5) + F.col("l_discount") * 5
    state = F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "R", "partial").otherwise("subset")
    combined = core * (F.lit(0.62) + F.lit(0.38) * (1 - F.col("l_tax") * 4))
    return li.select("l_orderkey", "l_linenumber", tier_of(classify(core, combined, state, F.col("l_linestatus") == "O")).alias("tier"))


@query("""
SELECT o_orderkey, 'WP/' || o_orderkey || '/' || year(o_orderdate) AS case_key FROM orders
""")
def case_key_norm(spark: SparkSession, sf: str) -> DataFrame:
    """One case number as four spellings print it; all give one key, however many digits it has."""
    year = F.year("o_orderdate").cast("string")
    key = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 4
    printed = F.when(kind == 0, F.concat(F.lit("W.P.No."), key, F.lit("/"), year)).when(kind == 1, F.concat(F.lit("WP "), key, F.lit(" of "), year)).when(kind == 2, F.concat(F.lit("w.p. "), key, F.lit(" / "), year)).otherwise(F.concat(F.lit("WP/00"), key, F.lit("/"), year))
    return t(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", case_key(printed).alias("case_key"))


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey % 1000 + 1 AS a, o_custkey % 12 AS n, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, 'RP/' || k || '/' || y AS case_key FROM (SELECT o_orderkey, y, unnest(range(a, a + n + 1)) AS k FROM r)
UNION ALL SELECT o_orderkey, 'AP/' || (a + 7) || '/' || y FROM r
""")
def range_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with a range and a single number whose year is printed once."""
    a, n = F.col("o_orderkey") % 1000 + 1, F.col("o_custkey") % 12
    text = lambda c: c.cast("string")
    cell = F.concat(F.lit("R.P.Nos."), text(a), F.lit(" to "), text(a + n), F.lit(", A.P."), text(a + 7), F.lit("/ "), text(F.year("o_orderdate")))
    keys, _ = expand_case_cells(t(spark, sf, "orders").select("o_orderkey", cell.alias("cell")), "o_orderkey", "cell")
    return keys.select("o_orderkey", "case_key")


@query("SELECT l_orderkey, round(1 - product((1 - l_discount) * (1 - l_tax)) + 1e-12, 9) AS confidence FROM lineitem GROUP BY l_orderkey")
def noisy_ors(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem", "l_orderkey", "l_discount", "l_tax")
    scores = F.flatten(F.collect_list(F.array("l_discount", "l_tax")))
    return li.groupBy("l_orderkey").agg(F.round(noisy_or(scores) + 1e-12, 9).alias("confidence"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS at_s FROM events), g AS (SELECT *, coalesce((at_s - lag(at_s) OVER (PARTITION BY user_id ORDER BY at_s) > 86400)::INTEGER, 0) AS s FROM e),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY at_s ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, island::BIGINT AS island, count(*) AS members, round(max(at_s) - min(at_s), 3) AS width FROM i GROUP BY user_id, island
""")
def gap_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Values of which neighbours are close form an island."""
    e = t(spark, sf, "events", "user_id", "ts").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    i = clusters(e, ["user_id"], "at", 86400.0, "island")
    return i.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("members"), F.round(F.max("at") - F.min("at"), 3).alias("width"))


@query("""
WITH f AS (SELECT item_id, unnest(regexp_split_to_array(text, '[,;|]|\\s{3,}|\\d{3,}')) AS s FROM benchmark),
w AS (SELECT item_id, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS k FROM f),
i AS (SELECT item_id, k, unnest(range(1, len(k) + 1)) AS a FROM w), n AS (SELECT item_id, k, a, unnest(range(0, 3)) AS m FROM i)
SELECT item_id, array_to_string(k[a:a + m], ' ') AS run, count(*) AS n FROM n WHERE a + m <= len(k) GROUP BY ALL
""")
def ngram_windows(spark: SparkSession, sf: str) -> DataFrame:
    """All runs of one to three words of a text's fragments."""
    return t(spark, sf, "benchmark", "item_id", "text").select("item_id", F.explode(name_windows(F.col("text"), 3)).alias("run")).groupBy("item_id", "run").agg(F.count("*").alias("n"))


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents), s AS (SELECT doc_id, trim(s) AS s FROM l)
SELECT doc_id, count(*) AS lines, count_if(s = '' OR regexp_full_match(s, '-+') OR regexp_matches(s, '\\d{{4,}}') OR regexp_matches(upper(s), '\\b({_WORDS(K.NOISE_WORDS)})\\b') OR length(s) > {K.NAME_MAX_CHARS})::BIGINT AS noise FROM s GROUP BY doc_id
""")
def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each document that can't be names."""
    lines = t(spark, sf, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(is_noise(F.col("s"))).alias("noise"))


@query("""
WITH i AS (SELECT p_partkey, p_brand, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN (p_size || 'A') WHEN 2 THEN '0' ELSE p_size::VARCHAR END AS item FROM part),
o AS (SELECT *, coalesce(nullif(try_cast(regexp_extract(item, '^\\s*(\\d+)', 1) AS BIGINT), 0), 1000000000) AS k FROM i)
SELECT p_partkey, k AS item_order, row_number() OVER (PARTITION BY p_brand ORDER BY k, p_partkey)::INTEGER AS place FROM o
""")
def natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Items in the order of their leading numbers, those without one last."""
    kind = F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    item = F.when(kind == 0, "").when(kind == 1, F.concat(size, F.lit("A"))).when(kind == 2, "0").otherwise(size)
    p = t(spark, sf, "part", "p_partkey", "p_brand", "p_size").withColumn("item_order", item_order(item))
    return p.select("p_partkey", "item_order", F.row_number().over(Window.partitionBy("p_brand").orderBy("item_order", "p_partkey")).alias("place"))


@query("""
WITH m AS (SELECT user_id, date_diff('second', max(ts), TIMESTAMP '2026-01-01') // 86400 AS days FROM events GROUP BY user_id)
SELECT user_id, days::INTEGER AS days, CASE WHEN days >= 45 THEN 'red' WHEN days >= 14 THEN 'amber' ELSE 'ok' END AS level FROM m
""")
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    """Age of each user's last event at a fixed time, and what it calls for."""
    e = t(spark, sf, "events", "user_id", "ts").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("u"))
    a = register_age(F.col("u"), F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    return e.select("user_id", a["days"].alias("days"), a["level"].alias("level"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders
""")
def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Dates as notices print them."""
    d = F.col("o_orderdate")
    printed = F.when(F.col("o_orderkey") % 5 == 0, "no date").when(F.col("o_orderkey") % 5 == 1, F.date_format(d, "d.M.yyyy")).otherwise(F.date_format(d, "'on' dd/MM/yyyy 'at 10.30 a.m.'"))
    return t(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", dates_iso(printed).alias("iso"))


@query("""
WITH t AS (SELECT item_id, text, string_split(text, ' ')[1] AS w FROM benchmark), p AS (SELECT item_id, string_split(text, w) AS k, length(w) AS n FROM t)
SELECT item_id, len(k) - 1 AS places, coalesce(list_sum(list_transform(range(1, len(k)), lambda i: list_sum(list_transform(k[1:i], lambda s: length(s))) + (i - 1) * n)), 0)::BIGINT AS starts FROM p
""")
def highlights(spark: SparkSession, sf: str) -> DataFrame:
    """All places of a text's first word in it."""
    b = t(spark, sf, "benchmark", "item_id", "text").withColumn("s", highlight_spans(F.col("text"), F.get(F.split("text", " "), F.lit(0))))
    return b.select("item_id", F.size("s").cast("long").alias("places"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["start"]).alias("starts"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return roster_match(spark, sf)

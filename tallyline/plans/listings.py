"""Queries that run the operators on listings shaped from the star-schema tables, and the same in plain SQL.

A listing's items, names, register and notices are made from the tables by fixed rules; the SQL states what the operators
find there. Registers and notices are given all their columns, those that a rule does not name as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline import constants as K
from tallyline.operators import adjournments, extraction, layout, matching, views
from tallyline.operators._common import ranked, written
from tallyline.operators.ranges import expand_case_cells
from tallyline.plans import name_sql as N
from tallyline.plans.catalogue import PRINTED, ROSTER, Query, part_roster, perturbed_names, t
from tallyline.sources import store, tabular

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> object:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _filled(df: DataFrame, kinds: dict[str, str], **given: Column) -> DataFrame:
    """The columns of `kinds` from `given`, null where that has none."""
    return df.select(*[(given[c] if c in given else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def register_of(df: DataFrame, **given: Column) -> DataFrame:
    return _filled(df, {c: "long" if c == "case_ord" else "map<string, string>" if c == "raw" else "string" for c in matching.REGISTER_FIELDS}, **given)


def notices_of(df: DataFrame, **given: Column) -> DataFrame:
    kinds = {"notice_ord": "long", "case_keys": "array<string>", "reposted_to": "string", "reposted_time": "string", "date_confidence": "string", "source_file": "string", "page": "int"}
    return _filled(df, kinds, **given)


def key(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# Joins ---------------------------------------------------------------------------------------------------------------


@query("""
WITH k AS (SELECT o_orderkey, 0 AS n, o_custkey % 500 AS key FROM orders UNION ALL SELECT o_orderkey, 1, o_custkey % 700 FROM orders),
r AS (SELECT c_custkey % 600 AS key, min(c_custkey) AS c_custkey FROM customer GROUP BY 1),
h AS (SELECT k.o_orderkey, k.n, k.key, r.c_custkey, row_number() OVER (PARTITION BY k.o_orderkey ORDER BY k.n) AS p FROM k JOIN r USING (key))
SELECT o_orderkey, 'WP/' || key || '/2024' AS matched_key, c_custkey AS register_row FROM h WHERE p = 1
""")
def register_join(spark: SparkSession, sf: str) -> DataFrame:
    """The first of an item's keys that the register has, and the register's first row for it."""
    wp = lambda c: key("WP", c, "2024")
    items = t(spark, sf, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("item_id"), F.array(wp(F.col("o_custkey") % 500), wp(F.col("o_custkey") % 700)).alias("case_keys"))
    register = register_of(t(spark, sf, "customer", "c_custkey"), case_ord=F.col("c_custkey"), case_key=wp(F.col("c_custkey") % 600))
    found = matching.match_case_numbers(items, register)
    return found.select(F.col("item_id").alias("o_orderkey"), "matched_key", F.col("by_key.case_ord").alias("register_row"))


@query("""
WITH r AS (SELECT k, max(c_custkey) AS row, min(c_custkey) AS first FROM (SELECT c_custkey, 'TNCH' || lpad((c_custkey % 900)::VARCHAR, 10, '0') AS k FROM customer) GROUP BY k),
i AS (SELECT o_orderkey, unnest(['TNCH' || lpad((o_custkey % 1000)::VARCHAR, 10, '0'), 'TNCH' || lpad((o_orderkey % 1000)::VARCHAR, 10, '0')]) AS k FROM orders)
SELECT o_orderkey, arg_min(row, first) AS register_row FROM i JOIN r USING (k) GROUP BY o_orderkey
""")
def cnr_join(spark: SparkSession, sf: str) -> DataFrame:
    """The register row whose CNR stands in an item's text, with other characters in between; of several the one named first."""
    cnr = lambda c: F.concat(F.lit("TNCH"), F.lpad(c.cast("string"), 10, "0"))
    spaced = lambda c: F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 5), F.lit(" "), F.substring(c, 10, 5))
    o = t(spark, sf, "orders", "o_orderkey", "o_custkey")
    items = o.select(F.col("o_orderkey").alias("item_id"), F.concat(F.lit("CNR: "), spaced(cnr(F.col("o_custkey") % 1000)), F.lit("; also "), cnr(F.col("o_orderkey") % 1000), F.lit(".")).alias("raw_text"))
    register = register_of(t(spark, sf, "customer", "c_custkey"), case_ord=F.col("c_custkey"), cnr=cnr(F.col("c_custkey") % 900))
    return matching.match_cnrs(items, register).select(F.col("item_id").alias("o_orderkey"), F.col("by_cnr.case_ord").alias("register_row"))


_PARTIES = """items AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN w[2] || ' ' || w[1] WHEN 2 THEN replace(replace(upper(p_name), 'E', 'EE'), 'U', 'OO') ELSE w[1] || ' trading co' END AS pet FROM (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)),
reg AS (SELECT p_name AS party, p_name || ' vs The State' AS title, row_number() OVER (ORDER BY encode(p_name)) - 1 AS k FROM (SELECT DISTINCT p_name FROM part))"""


@query(f"""
WITH {_PARTIES}, pets AS (SELECT DISTINCT pet FROM items),
{N.texts("SELECT pet || ' vs THE STATE' AS a, title AS b FROM pets, reg UNION SELECT pet, party FROM pets, reg UNION SELECT 'THE STATE', party FROM reg", "sim")},
s AS (SELECT pet, k, greatest(x.sim, y.sim, z.sim) AS sim FROM pets CROSS JOIN reg JOIN sim x ON x.a = pet || ' vs THE STATE' AND x.b = title JOIN sim y ON y.a = pet AND y.b = party JOIN sim z ON z.a = 'THE STATE' AND z.b = party),
r AS (SELECT *, lead(sim, 1, 0.0) OVER w AS second, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY pet ORDER BY sim DESC, k))
SELECT p_partkey, k AS register_row FROM items JOIN r USING (pet) WHERE n = 1 AND sim >= {K.PARTY_FALLBACK_MIN}::DOUBLE AND sim - second >= {K.PARTY_FALLBACK_MARGIN}::DOUBLE
""")
def runner_up_margin(spark: SparkSession, sf: str) -> DataFrame:
    """The register row whose parties fit an item's best, where it clearly leads the next; the SQL compares all pairs."""
    p = t(spark, sf, "part", "p_partkey", "p_name")
    w, kind = F.split("p_name", " "), F.col("p_partkey") % 4
    bent = F.replace(F.replace(F.upper("p_name"), F.lit("E"), F.lit("EE")), F.lit("U"), F.lit("OO"))
    pet = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat_ws(" ", w[1], w[0])).when(kind == 2, bent).otherwise(F.concat(w[0], F.lit(" trading co")))
    items = p.select(F.col("p_partkey").alias("item_id"), pet.alias("petitioner"), F.lit("THE STATE").alias("respondent"))
    names = p.select("p_name").distinct().withColumn("k", F.row_number().over(Window.orderBy("p_name")) - 1)
    register = register_of(names, case_ord=F.col("k"), cause_title=F.concat("p_name", F.lit(" vs The State")), party_name=F.col("p_name"))
    return matching.match_parties(items, register).select(F.col("item_id").alias("p_partkey"), F.col("by_party.case_ord").cast("long").alias("register_row"))


_OTHERS = "SELECT DISTINCT chr(65 + (p_partkey % 3)::INTEGER) || '. ' || p_name AS name FROM part"


@query(f"""
WITH {N.scores(_OTHERS, _OTHERS)},
r AS (SELECT *, row_number() OVER (PARTITION BY q_name ORDER BY round(combined, 9) DESC, encode(c_name)) AS n FROM scored WHERE q_name <> c_name AND core >= {K.CORE_GATE}::DOUBLE)
SELECT q_name AS q, c_name AS c, round(combined, 9) AS combined, state FROM r WHERE n = 1
""")
def fuzzy_block_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each name's closest other name beyond the gate, of all names; the SQL compares all pairs."""
    names = t(spark, sf, "part", "p_partkey", "p_name").select(F.concat(F.char(F.lit(65) + F.col("p_partkey") % 3), F.lit(". "), F.col("p_name")).alias("name")).distinct()
    pairs = matching.score_names(names, names).filter((F.col("q_name") != F.col("c_name")) & (F.col("core") >= K.CORE_GATE)).withColumn("combined", F.round("combined", 9))
    best = F.min_by(F.struct("c_name", "combined", "state"), F.struct(-F.col("combined"), "c_name")).alias("h")
    return pairs.groupBy(F.col("q_name").alias("q")).agg(best).select("q", F.col("h.c_name").alias("c"), "h.combined", "h.state")


def _keyed_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders", "o_orderkey", "o_custkey")
    tier = F.when(F.col("o_orderkey") % 3 == 0, "auto").otherwise("review")
    return o.select(F.col("o_orderkey").alias("item_id"), "o_custkey", F.array(key("WP", F.col("o_orderkey"), "2024"), key("AP", F.col("o_custkey"), "2024")).alias("case_keys"), tier.alias("tier"))


def _returned(spark: SparkSession, sf: str) -> DataFrame:
    """A notice row per returned line, with the order's key, and another that no list has."""
    li = t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").filter("l_returnflag = 'R'")
    keys = F.array(key("XX", F.col("l_linenumber"), "2020"), key("WP", F.col("l_orderkey"), "2024"))
    sure = F.when(F.col("l_orderkey") % 2 == 0, "ruled").otherwise("inferred")
    return notices_of(li, notice_ord=F.col("l_orderkey") * 10 + F.col("l_linenumber"), case_keys=keys, reposted_to=F.concat(F.lit("2026-09-0"), F.col("l_linenumber").cast("string")), date_confidence=sure)


_REPOSTED = "SELECT l_orderkey AS k, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"


@query(f"""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'auto' ELSE 'review' END AS tier, '2026-09-0' || n AS reposted_to FROM orders JOIN ({_REPOSTED}) r ON r.k = o_orderkey
""")
def adjourn_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that a notice reposts, by its first row; a date that was inferred holds the tier."""
    _, gone = adjournments.apply_adjournments(_keyed_orders(spark, sf), _returned(spark, sf))
    return gone.select(F.col("item_id").alias("o_orderkey"), "o_custkey", "tier", "adjourned.reposted_to")


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'auto' ELSE 'review' END AS tier FROM orders ANTI JOIN ({_REPOSTED}) r ON r.k = o_orderkey")
def adjourn_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that no notice reposts."""
    stay, _ = adjournments.apply_adjournments(_keyed_orders(spark, sf), _returned(spark, sf))
    return stay.select(F.col("item_id").alias("o_orderkey"), "o_custkey", "tier")


@query("""
WITH n AS (SELECT o_orderkey, 0 AS k, o_custkey * 2 AS key FROM orders UNION ALL SELECT o_orderkey, 1, o_custkey + 1 FROM orders),
seen AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 3 = 0),
h AS (SELECT n.*, c.c_custkey, s.s_suppkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS p FROM n
  LEFT JOIN customer c ON c.c_custkey = n.key LEFT JOIN supplier s ON s.s_suppkey = n.key
  WHERE (c.c_custkey IS NOT NULL OR s.s_suppkey IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.key = n.key))
SELECT o_orderkey, 'WP/' || key || '/2024' AS case_key, CASE WHEN c_custkey IS NOT NULL THEN 'register' ELSE 'ledger' END AS identified_from, CASE WHEN s_suppkey IS NOT NULL THEN 'S' || s_suppkey END AS ledger_title FROM h WHERE p = 1
""")
def notice_only(spark: SparkSession, sf: str) -> DataFrame:
    """The first key of a notice that no match has and the register, or else the ledger, knows."""
    wp = lambda c: key("WP", c, "2024")
    o = t(spark, sf, "orders", "o_orderkey", "o_custkey")
    reposted = notices_of(o, notice_ord=F.col("o_orderkey"), case_keys=F.array(wp(F.col("o_custkey") * 2), wp(F.col("o_custkey") + 1)))
    seen = t(spark, sf, "lineitem", "l_partkey", "l_returnflag").filter("l_returnflag = 'A' and l_partkey % 3 = 0").select(F.array(wp(F.col("l_partkey"))).alias("case_keys"))
    register = register_of(t(spark, sf, "customer", "c_custkey"), case_ord=F.col("c_custkey"), case_key=wp(F.col("c_custkey")))
    ledger = t(spark, sf, "supplier", "s_suppkey").select(wp(F.col("s_suppkey")).alias("case_key"), F.concat(F.lit("S"), text("s_suppkey")).alias("cause_title"))
    return adjournments.notice_only(seen, reposted, register, ledger).select(F.col("reposted.notice_ord").alias("o_orderkey"), "case_key", "identified_from", "ledger_title")


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), c AS (SELECT * FROM a INTERSECT SELECT * FROM b)
SELECT (SELECT count(*) FROM a) AS listed, (SELECT count(*) FROM b) AS noticed, (SELECT count(*) FROM c) AS both_have, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_listed, round((SELECT count(*) FROM c)::DOUBLE / (SELECT count(*) FROM b), 9) AS share
""")
def key_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of lists and notices, in both, and in one alone."""
    items = t(spark, sf, "orders", "o_custkey").select(F.array(key("WP", F.col("o_custkey"), "2024")).alias("case_keys"))
    reposted = t(spark, sf, "customer", "c_custkey", "c_acctbal").filter("c_acctbal > 0").select(F.array(key("WP", F.col("c_custkey"), "2024")).alias("case_keys"))
    return adjournments.key_overlap(items, reposted).withColumn("share", F.round("share", 9))


@query("""
WITH m AS (SELECT d.doc_id, CASE d.doc_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'review' ELSE 'weak' END AS tier, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN quality = 1 AND tier = 'review' THEN 'auto' ELSE tier END AS tier, quality = 1 AS confirmed FROM m WHERE coalesce(quality, 1) <> 0
""")
def memory_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Remembered decisions: yes lifts review to auto, no drops the row."""
    kind = F.col("doc_id") % 3
    matches = t(spark, sf, "documents", "doc_id").select("doc_id", text("doc_id").alias("confirm_key"), F.when(kind == 0, "auto").when(kind == 1, "review").otherwise("weak").alias("tier"))
    memory = t(spark, sf, "labels", "doc_id", "quality").select(text("doc_id").alias("confirm_key"), (F.col("quality") == 1).alias("confirmed"))
    return matching.apply_memory(matches, memory).select("doc_id", "tier", "confirmed")


@query("""
WITH b AS (SELECT c_nationkey AS g, c_custkey AS item, c_acctbal AS bottom, c_acctbal + 20 AS top FROM customer),
p AS (SELECT s_nationkey AS g, s_suppkey AS point, s_acctbal AS y FROM supplier),
x AS (SELECT point, item, top, y <= top + 1 AND y >= bottom - 1 AS inside, CASE WHEN y <= top + 1 AND y >= bottom - 1 THEN 0 WHEN y > top THEN y - top ELSE bottom - y END AS gap FROM p JOIN b USING (g)),
r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY inside DESC, gap, top DESC, item) AS n FROM x)
SELECT point, CASE WHEN gap <= 40 THEN item END AS item, gap <= 40 AND inside AS within FROM r WHERE n = 1
""")
def nearest_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The item whose band holds a point of its page, else the nearest within 40."""
    page = lambda c: [text(c).alias("file"), F.lit(1).alias("page")]
    items = t(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal").select(*page("c_nationkey"), F.col("c_custkey").alias("item_id"), (F.col("c_acctbal") + 20).alias("y_top"), F.col("c_acctbal").alias("y_bot"))
    points = t(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(*page("s_nationkey"), F.col("s_suppkey").alias("point"), F.col("s_acctbal").alias("y"))
    return extraction.nearest_items(points, items).select("point", F.col("item_id").alias("item"), "within")


# Fusion and views ----------------------------------------------------------------------------------------------------


def listing(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """An item per part with one printed name, a register of suppliers, and the roster of all part names."""
    parts = t(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size")
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    cases = F.array(key("WP", k % 900, "2024"))
    court = F.when(k % 10 != 0, F.col("p_brand"))
    items = parts.select(k.alias("item_id"), court.alias("court"), text("p_size").alias("hall"), text(k % 50).alias("item_no"), F.lit(False).alias("item_no_inherited"), F.lit(False).alias("source_official"), F.lit(1).alias("page"), F.lit("list").alias("source_file"), cases.alias("case_numbers"), cases.alias("case_keys"), F.lit("").alias("petitioner"), F.lit("").alias("respondent"), F.concat(F.lit("Enrolment MS-"), text(k % 40 + 10_000)).alias("raw_text"), F.expr("cast(map() as map<string, string>)").alias("extra"), (F.col("p_size") % 2 == 0).alias("was_ocr"), (k % 13 == 0).alias("low_page"))
    loose = k % 11 == 0
    names = perturbed_names(parts).select(k.alias("item_id"), F.lit(0).alias("name_ord"), F.col("printed").alias("name"), F.when(loose, "unplaced").otherwise("counsel").alias("match_role"), F.lit("petitioner").alias("side"), none.alias("side_detail"), F.when(loose, "B").otherwise("A").alias("source"), (k % 22 == 0).alias("near_only"), none.alias("advocate_key"), (k % 4 == 0).alias("confirmed_by_both"))
    roster = part_roster(parts).withColumn("enrolment", F.concat(F.lit("MS/"), text(F.col("advocate_ord") + 10_000)))
    s = F.col("s_suppkey")
    register = register_of(t(spark, sf, "supplier", "s_suppkey", "s_name"), case_ord=s, case_key=key("WP", s % 60, "2024"), diary_no=F.concat(F.lit("D"), text(s)), attended_by=F.col("s_name"), counsel_for=F.when(s % 2 == 0, "Respondent"))
    return {"items": items, "names": names, "roster": roster, "register": register}


def matched(spark: SparkSession, sf: str, *shared: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The listing's matches and its tables. shared: the columns that several steps use, which are written once; without any
    the matches are made by the one step that reads them, as far as it needs their columns."""
    x = listing(spark, sf)
    m = matching.match_items(x["items"], x["names"], x["roster"], x["register"])
    return written(m.select(*shared)) if shared else m, x


_RANKS = "['none', 'weak', 'review', 'auto']"
#: CTEs ending in m: all matches of the listing.
MATCHES = f"""{N.scores(f"SELECT name FROM ({ROSTER})", f"SELECT name FROM ({PRINTED})")},
rosters AS ({ROSTER}), printed AS ({PRINTED}),
reg AS (SELECT s_suppkey % 60 AS k, min(s_suppkey) AS row FROM supplier GROUP BY 1),
i AS (SELECT p.p_partkey AS id, p.name, p.p_size % 2 = 0 AS ocr, p.p_partkey % 13 = 0 AS low, p.p_partkey % 11 = 0 AS loose, p.p_partkey % 22 = 0 AS near, p.p_partkey % 40 AS e, reg.row, p.p_partkey % 900 AS k,
  CASE WHEN p.p_partkey % 10 <> 0 THEN p.p_brand END AS court, p.p_size AS hall FROM printed p LEFT JOIN reg ON reg.k = p.p_partkey % 900),
h0 AS (SELECT i.*, r.advocate_ord, r.name AS advocate, s.core, s.combined, s.state, {N.rank("s.core", "s.combined", "s.state", "i.ocr")} AS rank FROM i JOIN scored s ON s.c_name = i.name JOIN rosters r ON r.name = s.q_name),
h AS (SELECT * FROM h0 WHERE rank > 0 AND NOT (loose AND rank < 2 AND row IS NOT NULL)),
n AS (SELECT id, count(*) FILTER (NOT loose AND rank >= 2) AS strong FROM h GROUP BY id),
a AS (SELECT h.*, strong >= 2 AND NOT loose AS cluster, advocate_ord = e AS esig FROM h JOIN n USING (id)
  UNION ALL BY NAME SELECT i.*, false AS cluster, false AS esig FROM i WHERE row IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.id = i.id)),
b AS (SELECT *, CASE WHEN esig THEN 3 WHEN row IS NOT NULL AND (rank IS NULL OR rank >= 2) THEN 3 ELSE coalesce(rank, 0) END AS t0 FROM a),
c1 AS (SELECT *, CASE WHEN cluster AND t0 = 2 THEN 3 ELSE t0 END AS before_cap FROM b),
c2 AS (SELECT *, least(before_cap, CASE WHEN rank IS NOT NULL AND loose AND row IS NULL THEN 2 ELSE 3 END, CASE WHEN rank IS NOT NULL AND near THEN 1 ELSE 3 END, CASE WHEN low THEN 2 ELSE 3 END) AS final FROM c1),
m AS (SELECT *, {_RANKS}[final + 1] AS tier, {_RANKS}[before_cap + 1] AS tier_before_cap,
  round(1 - (1 - least(1, coalesce(combined, 0))) * CASE WHEN row IS NOT NULL THEN 0 ELSE 1 END * CASE WHEN esig THEN 1 - {K.SIGNAL_WEIGHTS["enrolment"]}::DOUBLE ELSE 1 END * CASE WHEN cluster THEN 1 - {K.SIGNAL_WEIGHTS["cluster"]}::DOUBLE ELSE 1 END, 6) AS confidence,
  array_to_string(list_filter([CASE WHEN rank IS NOT NULL THEN 'advocateName' END, CASE WHEN row IS NOT NULL THEN 'caseNumber' END, CASE WHEN esig THEN 'enrolment' END, CASE WHEN cluster THEN 'cluster' END], lambda x: x IS NOT NULL), ',') AS kinds FROM c2 WHERE final > 0)"""


@query(f"""
WITH {MATCHES}
SELECT id AS item_id, advocate, row AS register_row, tier, tier_before_cap, confidence, kinds, CASE WHEN rank IS NULL THEN 'caseNumber' ELSE 'name' END AS identified_by, CASE WHEN loose AND rank IS NOT NULL THEN 'B' ELSE 'A' END AS found_by,
  coalesce(row % 2 = 0 AND rank IS NOT NULL, false) AS side_mismatch FROM m
""")
def match_items(spark: SparkSession, sf: str) -> DataFrame:
    """All matches of the listing: signals, promotions, caps, confidence."""
    m, _ = matched(spark, sf)
    kinds = F.array_join(F.transform("signals", lambda s: s["kind"]), ",")
    return m.select("item_id", "advocate", F.col("register_case.case_ord").alias("register_row"), "tier", "tier_before_cap", F.round("confidence", 6).alias("confidence"), kinds.alias("kinds"), "identified_by", "found_by", "side_mismatch")


@query(f"WITH {MATCHES} SELECT id AS item_id, count(*) AS advocates, max(confidence) AS confidence FROM m WHERE cluster GROUP BY id")
def cluster_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Items on which several advocates are found, each of which counts for the others."""
    m, _ = matched(spark, sf)
    m = m.filter(F.exists("signals", lambda s: s["kind"] == "cluster"))
    return m.groupBy("item_id").agg(F.count("*").alias("advocates"), F.max(F.round("confidence", 6)).alias("confidence"))


@query(f"""
WITH {MATCHES}, o AS (SELECT * FROM m WHERE advocate IS NOT NULL)
SELECT x.id AS item_id, x.advocate AS owner, coalesce(array_to_string(list_transform(list_sort(list({{'k': y.advocate_ord, 'n': y.advocate}}) FILTER (y.id IS NOT NULL)), lambda z: z.n), '; '), '') AS also_under FROM o x LEFT JOIN o y ON x.id = y.id AND x.advocate <> y.advocate GROUP BY x.id, x.advocate
""")
def also_under(spark: SparkSession, sf: str) -> DataFrame:
    """Matches by owner, each with the other advocates on its item."""
    m, x = matched(spark, sf, "item_id", "advocate_ord", "advocate", "register_advocate")
    return views.by_advocate(m, x["roster"]).select("item_id", "owner", F.array_join("also_under", "; ").alias("also_under"))


@query(f"""
WITH {MATCHES}
SELECT id AS item_id, coalesce(array_to_string(list_transform(list_sort(list({{'k': advocate_ord, 'n': advocate}}) FILTER (advocate IS NOT NULL)), lambda z: z.n), ', '), '') AS advocates, arg_min(tier, coalesce(advocate_ord, 1073741824)) AS tier FROM m GROUP BY id
""")
def view_by_case(spark: SparkSession, sf: str) -> DataFrame:
    """A row per item with all its advocates, and its first match."""
    m, _ = matched(spark, sf)
    return views.by_case(m.select("item_id", "advocate_ord", "advocate", "tier")).select("item_id", F.array_join("advocates", ", ").alias("advocates"), "tier")


@query(f"""
WITH {MATCHES}, v AS (SELECT coalesce(court, 'Court not stated') AS court, hall, id, coalesce(nullif(id % 50, 0), 1000000000) AS k FROM m), r AS (SELECT *, row_number() OVER (ORDER BY court, hall, k, id) AS n FROM v)
SELECT court, hall::VARCHAR AS hall, count(*) AS matches, min(n) - 1 AS first_place FROM r GROUP BY ALL
""")
def view_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Matches by court, hall and item number: the place of each group in that order, and its size."""
    m, _ = matched(spark, sf)
    ordered = written(views.by_court(m.select("item_id", "court", "hall", "item_no")).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("_b") + F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)
    return ordered.join(F.broadcast(before.select("_p", "_b")), "_p").groupBy(F.col("view_court").alias("court"), F.col("view_hall").alias("hall")).agg(F.count("*").alias("matches"), F.min(place).alias("first_place"))


@query(f"""
WITH {MATCHES}, g AS (SELECT *, k % 3 = 0 AS gone FROM m), s AS (SELECT * FROM g WHERE NOT gone)
SELECT (SELECT count(*) FROM s WHERE tier = 'auto') AS auto, (SELECT count(*) FROM s WHERE tier = 'review') AS review, (SELECT count(*) FROM s WHERE tier = 'weak') AS weak, (SELECT count(DISTINCT coalesce(court, '')) FROM s WHERE tier <> 'weak') AS courts,
  (SELECT count(*) FROM g WHERE gone AND CASE WHEN tier = 'auto' THEN 'review' ELSE tier END = 'weak') AS adjourned_weak, (SELECT count(*) FROM g WHERE gone AND tier <> 'weak') AS adjourned
""")
def tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Matches by tier and courts involved, and what a notice takes out of them."""
    m, x = matched(spark, sf, "item_id", "case_keys", "court", "tier")
    reposted = _every_third(x["items"])
    stay, gone = adjournments.apply_adjournments(m, reposted)
    return views.counts(stay, gone, adjournments.notice_only(m, reposted, x["register"].limit(0)))


def _every_third(items: DataFrame) -> DataFrame:
    """A notice for each matter of which the number is divisible by three."""
    number = F.split("case_key", "/")[1].cast("long")
    keys = items.select(F.explode("case_keys").alias("case_key")).distinct().filter(number % 3 == 0)
    return notices_of(keys, notice_ord=number, case_keys=F.array("case_key"), reposted_to=F.lit("2026-09-01"), date_confidence=F.lit("inferred"), source_file=F.lit("notice"), page=F.lit(2))


#: What the flat export reads of a match.
_EXPORTED = "item_id case_keys case_numbers court hall item_no item_no_inherited petitioner respondent advocate register_advocate matched_text match_role identified_by side side_detail tier confidence signals register_case source_file source_official page was_ocr".split()


@query(f"""
WITH {MATCHES}, lone AS (SELECT DISTINCT k FROM i SEMI JOIN (SELECT DISTINCT s_suppkey % 60 AS k FROM supplier) r USING (k) WHERE k % 3 = 0 AND k NOT IN (SELECT k FROM m))
SELECT 'WP/' || k || '/2024' AS "CaseNumber", coalesce(advocate, s.s_name, '') AS "FirmAdvocate", CASE WHEN k % 3 = 0 AND tier = 'auto' THEN 'To confirm' ELSE CASE tier WHEN 'auto' THEN 'Matched' WHEN 'review' THEN 'To confirm' ELSE 'Weak' END END AS "Tier", replace(kinds, ',', ', ') AS "Signals", coalesce('D' || row, '') AS "DiaryNo",
  CASE WHEN k % 3 = 0 THEN 'YES: reposted, not heard today' ELSE '' END AS "Adjourned", CASE WHEN k % 3 = 0 THEN '2026-09-01 (inferred date, to be confirmed)' ELSE '' END AS "RepostedTo", CASE WHEN ocr THEN 'recognised' ELSE 'text layer' END AS "WasOCR", 1 AS "PageNo"
FROM m LEFT JOIN supplier s ON s.s_suppkey = m.row
UNION ALL SELECT 'WP/' || k || '/2024', s_name, NULL, 'known from the register', 'D' || s_suppkey, 'YES: on no list that was loaded', '2026-09-01', NULL, 2 FROM lone JOIN (SELECT s_suppkey % 60 AS k, min(s_suppkey) AS s_suppkey, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1) USING (k)
""")
def export_union(spark: SparkSession, sf: str) -> DataFrame:
    """The flat export of matches, adjourned ones among them, and of matters that only a notice has."""
    m, x = matched(spark, sf, *_EXPORTED)
    reposted = _every_third(x["items"])
    stay, gone = adjournments.apply_adjournments(m, reposted)
    only = adjournments.notice_only(m, reposted, x["register"])
    rows = views.export_rows(stay.unionByName(gone, allowMissingColumns=True)).unionByName(views.export_notice_only(only), allowMissingColumns=True)
    return rows.select("CaseNumber", "FirmAdvocate", "Tier", "Signals", "DiaryNo", "Adjourned", "RepostedTo", "WasOCR", "PageNo")


@query(f"""
WITH {MATCHES}, e AS (SELECT id AS item_id, advocate, unnest([
  {{'field': 'where', 'verdict': CASE WHEN loose AND rank IS NOT NULL THEN 'differ' END}}, {{'field': 'caseNumber', 'verdict': CASE WHEN row IS NOT NULL THEN 'agree' ELSE 'absent' END}}, {{'field': 'cnr', 'verdict': 'absent'}}, {{'field': 'causeTitle', 'verdict': 'absent'}}, {{'field': 'parties', 'verdict': 'absent'}},
  {{'field': 'advocate', 'verdict': CASE WHEN advocate IS NULL THEN 'absent' WHEN regexp_replace(upper(name), '[^A-Z]', '', 'g') = regexp_replace(upper(advocate), '[^A-Z]', '', 'g') THEN 'agree' ELSE 'differ' END}},
  {{'field': 'side', 'verdict': CASE WHEN row % 2 = 0 THEN CASE WHEN rank IS NOT NULL THEN 'differ' ELSE 'agree' END ELSE 'absent' END}}, {{'field': 'nextStage', 'verdict': 'absent'}}]) AS x FROM m)
SELECT x.field AS field, x.verdict AS verdict, count(*) AS matches, count(DISTINCT item_id) AS items FROM e WHERE x.verdict IS NOT NULL GROUP BY ALL
""")
def evidence_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """What speaks for and against each match, field by field."""
    m, _ = matched(spark, sf)
    e = views.evidence(m, True).select("item_id", F.explode("evidence").alias("e"))
    return e.groupBy("e.field", "e.verdict").agg(F.count("*").alias("matches"), F.count_distinct("item_id").alias("items"))


# Stores --------------------------------------------------------------------------------------------------------------


@query(f"""
WITH e AS (SELECT user_id, event_id % 2 AS half, event_id AS n, CASE WHEN event_id % 3 = 0 THEN event_type END AS title, strftime(ts, '%Y-%m') AS month FROM events),
base AS (SELECT max(f) + 1 AS b FROM (SELECT min(n) AS f FROM e WHERE half = 0 GROUP BY user_id)),
o AS (SELECT *, n + CASE WHEN half = 1 THEN (SELECT b FROM base) ELSE 0 END AS pos FROM e),
d AS (SELECT user_id, string_agg(month, ',' ORDER BY f) AS dates FROM (SELECT user_id, month, min((half, n)) AS f FROM o GROUP BY 1, 2) GROUP BY 1)
SELECT 'WP/' || user_id || '/2024' AS case_key, arg_min(title, (half, n)) FILTER (WHERE title IS NOT NULL) AS parties, any_value(dates) AS dates, min(pos) AS first_seen FROM o JOIN d USING (user_id) GROUP BY user_id ORDER BY first_seen DESC, case_key DESC LIMIT {K.LEDGER_CAP}
""")
def ledger_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of matters merged into the ledger: earlier values stay, dates are added."""
    e = t(spark, sf, "events", "event_id", "user_id", "ts", "event_type")
    none = F.lit(None).cast("string")
    month = F.struct(F.date_format("ts", "yyyy-MM").alias("reposted_to")).alias("adjourned")
    matches = e.select("event_id", F.array(key("WP", F.col("user_id"), "2024")).alias("case_keys"), F.col("event_id").alias("seen_ord"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("petitioner"), none.alias("respondent"), none.alias("advocate"), none.alias("court"), month)
    ledger = spark.createDataFrame([], store.LEDGER)
    for half in (0, 1):
        ledger = store.merge_ledger(ledger, store.ledger_entries(matches.filter(F.col("event_id") % 2 == half), ""), K.LEDGER_CAP if half else 1 << 30)
    return ledger.select("case_key", "parties", F.array_join(F.transform("dates", lambda d: F.replace(d, F.lit("reposted "), F.lit(""))), ",").alias("dates"), "first_seen")


@query("""
WITH k AS (SELECT p_partkey, p_name, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS k FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS n FROM k)
SELECT p_partkey AS advocate_ord, p_name AS name, 'MS/' || p_partkey AS enrolment, 'Senior' AS role FROM r WHERE n = 1
""")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    """A roster of lines: the first of each person, with what stands after the name."""
    lines = t(spark, sf, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("ord"), F.concat(F.col("p_name"), F.lit(" ;  MS/"), text("p_partkey"), F.lit(" | Senior")).alias("value"))
    return tabular.parse_roster_lines(lines)


# Pages ---------------------------------------------------------------------------------------------------------------

#: Lines of orders, numbered from 1 without gaps, and how many there are.
NUMBERED = """SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS last FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)"""


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    li = li.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    return li.withColumn("last", F.count("*").over(Window.partitionBy("l_orderkey"))).withColumns({"file": text("l_orderkey"), "page": F.lit(1)})


@query(f"""
SELECT l_orderkey, (n - 1)::INTEGER AS line, (700 - 12 * n)::DOUBLE AS y, 'Q' || l_quantity::INTEGER || ' P' || l_partkey || 'S' || l_suppkey AS text FROM ({NUMBERED})
""")
def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of pages: three spans each, of which two touch and one stands apart."""
    span = lambda n, x, s: F.struct(F.lit(n).cast("long").alias("n"), F.lit(x).alias("x"), F.lit(20.0).alias("w"), s.alias("text"))
    spans = F.array(span(0, 100.0, F.concat(F.lit("P"), text("l_partkey"))), span(1, 120.0, F.concat(F.lit("S"), text("l_suppkey"))), span(2, 10.0, F.concat(F.lit("Q"), text(F.col("l_quantity").cast("int")))))
    spans = numbered(spark, sf).select("file", "page", (700.0 - 12 * F.col("n")).alias("y"), "n", F.explode(spans).alias("s"))
    spans = spans.select("file", "page", (F.col("n") * 3 + F.col("s.n")).alias("ord"), "s.x", "y", "s.w", "s.text")
    return layout.lines(spans).select(F.col("file").cast("long").alias("l_orderkey"), "line", "y", "text")


@query(f"""
WITH g AS (SELECT *, n - 1 AS r, sum(CASE WHEN n = 1 OR n % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n) AS grp FROM ({NUMBERED}) WHERE last >= 2),
x AS (SELECT l_orderkey, grp, string_agg('S' || l_suppkey, ' ' ORDER BY r) AS text, min(r) AS owner FROM g GROUP BY 1, 2)
SELECT l_orderkey, r::INTEGER AS r, 0 AS c, r::INTEGER AS owner_r, 'P' || l_partkey AS text FROM g
UNION ALL SELECT g.l_orderkey, g.r::INTEGER, 1, x.owner::INTEGER, x.text FROM g JOIN x USING (l_orderkey, grp)
""")
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of ruled tables, a row per line of an order; below even rows no rule parts the second column, so cells there
    continue."""
    li, n, f = numbered(spark, sf), F.col("n"), F.lit
    y = lambda k: 700.0 - 20 * k
    span = lambda k, x, s: F.struct((n * 2 + k).cast("long").alias("ord"), f(x).alias("x"), s.alias("text"))
    spans = li.select("file", "page", F.explode(F.array(span(0, 5.0, F.concat(f("P"), text("l_partkey"))), span(1, 55.0, F.concat(f("S"), text("l_suppkey"))))).alias("s"), (y(n) + 10).alias("y"))
    spans = spans.select("file", "page", "s.ord", "s.x", "y", f(20.0).alias("w"), "s.text")
    below = F.struct(y(n).alias("y"), f(0.0).alias("x0"), F.when((n % 2 == 1) | (n == F.col("last")), 100.0).otherwise(50.0).alias("x1"))
    top = F.when(n == 1, F.struct(f(700.0).alias("y"), f(0.0).alias("x0"), f(100.0).alias("x1")))
    hsegs = li.select("file", "page", F.explode(F.filter(F.array(top, below), lambda s: s.isNotNull())).alias("h")).select("file", "page", "h.*")
    vsegs = li.filter("n = 1").select("file", "page", F.explode(F.array(f(0.0), f(50.0), f(100.0))).alias("x"), y(F.col("last")).alias("y0"), f(700.0).alias("y1"))
    cells = layout.cells(spans, hsegs, vsegs)
    return cells.select(F.col("file").cast("long").alias("l_orderkey"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("owner_r").cast("int").alias("owner_r"), "text")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' Ltd' WHEN 2 THEN 'R3 ' || p_name ELSE p_name || ' throughout' END AS party,
  CASE p_partkey % 4 WHEN 0 THEN 'X.' || p_name WHEN 1 THEN 'Y;Z' WHEN 2 THEN 'K.Zed' ELSE '' END AS advocates, CASE WHEN p_partkey % 4 = 2 THEN 'R3' WHEN p_partkey % 4 = 1 THEN ';' ELSE '' END AS acts_for FROM part
""")
def split_party_counsel(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with a party and its counsel either way round, with two of each, and with none."""
    kind, name = F.col("p_partkey") % 4, F.col("p_name")
    cell = F.when(kind == 0, F.concat(name, F.lit(" through Thiru. X."), name)).when(kind == 1, F.concat(name, F.lit(" Ltd, rep. by M/s.Y 2. Other through Tmt. Z"))).when(kind == 2, F.concat(F.lit("K.Zed for R3 "), name)).otherwise(F.concat(name, F.lit(" throughout")))
    out = t(spark, sf, "part", "p_partkey", "p_name").withColumn("s", extraction.split_party_counsel(cell))
    each = lambda f: F.array_join(F.transform("s.advocates", lambda a: F.coalesce(a[f], F.lit(""))), ";")
    return out.select("p_partkey", F.col("s.party").alias("party"), each("name").alias("advocates"), each("side_detail").alias("acts_for"))


@query("""
WITH c AS (SELECT p_brand, p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' through Thiru. X' WHEN 1 THEN p_name || ' rep. by M/s.Y' WHEN 2 THEN 'Z for R1 ' || p_name ELSE p_name || ' throughout' END AS s FROM part),
h AS (SELECT p_brand, regexp_matches(s, '(through Thiru|rep\\. by M)') AS pf, regexp_matches(s, '\\bfor R\\d') AS cf FROM c)
SELECT p_brand, count(*) AS cells, count_if(pf)::BIGINT AS pf, count_if(NOT pf AND cf)::BIGINT AS cf, round(greatest(count_if(pf), count_if(NOT pf AND cf)) / count(*), 9) AS density,
  CASE WHEN count_if(pf) >= count_if(NOT pf AND cf) AND count_if(pf) > 0 THEN 'party-first' WHEN count_if(NOT pf AND cf) > 0 THEN 'counsel-first' END AS direction FROM h GROUP BY p_brand
""")
def connector_probe(spark: SparkSession, sf: str) -> DataFrame:
    """How many cells of a column join a party to its counsel; a word that only begins like a connector is none."""
    kind = F.col("p_partkey") % 4
    s = F.when(kind == 0, F.concat("p_name", F.lit(" through Thiru. X"))).when(kind == 1, F.concat("p_name", F.lit(" rep. by M/s.Y"))).when(kind == 2, F.concat(F.lit("Z for R1 "), "p_name")).otherwise(F.concat("p_name", F.lit(" throughout")))
    cells = t(spark, sf, "part", "p_partkey", "p_brand", "p_name").select(F.col("p_brand").alias("file"), F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.lit(3).alias("n_cols"), (F.col("p_partkey") + 1).alias("r"), (F.col("p_partkey") + 1).alias("owner_r"), F.lit(2).alias("c"), s.alias("text"))
    return extraction.probe_columns(cells).select(F.col("file").alias("p_brand"), "cells", "pf", "cf", F.round("density", 9).alias("density"), "direction")


@query("""
WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, CASE WHEN event_id % 3 = 0 THEN (event_id % 40)::VARCHAR END AS v FROM events)
SELECT user_id, page::INTEGER AS page, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS hall FROM e
""")
def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that state no hall take that of the page before."""
    e = t(spark, sf, "events", "event_id", "user_id", "ts").withColumn("page", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    e = e.select(text("user_id").alias("file"), "page", "event_id")
    lines = e.select("file", "page", F.lit(0).alias("line"), F.lit(0.0).alias("x0"), F.lit(10.0).alias("width"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("COURT NO. "), text(F.col("event_id") % 40))).otherwise("no hall here").alias("text"))
    context = extraction.page_context(lines, e.select("file", "page", F.lit(600.0).alias("width")))
    return context.select(F.col("file").cast("long").alias("user_id"), "page", "hall")


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 1 THEN year(ts) END AS v FROM events),
f AS (SELECT event_id, user_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM e)
SELECT user_id, n::INTEGER AS key_ord, 'WP/' || event_id || '/' || y AS case_key FROM f WHERE y IS NOT NULL
""")
def back_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of a cell without a year take the next one that is printed."""
    e = t(spark, sf, "events", "event_id", "user_id", "ts")
    part = F.concat(text("event_id"), F.when(F.col("event_id") % 4 == 1, F.concat(F.lit(" / "), text(F.year("ts")))).otherwise(""))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", part.alias("p")))), lambda s: s["p"])
    cells = e.groupBy("user_id").agg(F.concat(F.lit("W.P.Nos."), F.array_join(listed, ", ")).alias("cell"))
    return expand_case_cells(cells, "user_id", "cell")[0]


@query(f"""
WITH g AS (SELECT *, (n - 1) // 3 AS item FROM ({NUMBERED}))
SELECT l_orderkey, (item + 1)::VARCHAR AS item_no, 'WP/' || l_orderkey || '/' || (2000 + item) AS case_key, string_agg('PARTY' || l_partkey, ' ' ORDER BY n) FILTER (n % 3 = 1) AS petitioner, coalesce(string_agg('OTHER' || l_partkey, ' ' ORDER BY n) FILTER (n % 3 <> 1), '') AS respondent, count(*) AS lines FROM g GROUP BY l_orderkey, item
""")
def item_segmentation(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without rules cut into items where a number and a case open one, and its parties at VS."""
    li = numbered(spark, sf)
    item, at = F.floor((F.col("n") - 1) / 3), F.col("n") % 3
    line = F.when(at == 1, F.concat(text(item + 1), F.lit("  WP/"), text("l_orderkey"), F.lit("/"), text(item + 2000), F.lit(" PARTY"), text("l_partkey"))).otherwise(F.concat(F.when(at == 2, "VS ").otherwise(""), F.lit("OTHER"), text("l_partkey")))
    span = F.struct((700.0 - 12 * F.col("n")).alias("y"), F.lit(10.0).alias("x"), F.col("n").cast("long").alias("ord"), F.lit(100.0).alias("w"), line.alias("text"))
    lines = li.select("file", "page", (F.col("n") - 1).alias("line"), span["y"].alias("y"), span["x"].alias("x0"), span["w"].alias("width"), F.array(span).alias("spans"), line.alias("text"))
    pages = li.select("file", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0), "was_ocr": F.lit(False)})
    context = pages.select("file", "page", *[F.lit(None).cast("string").alias(c) for c in ("court", "hall", "coram", "list_type")])
    items, _ = extraction.column_items(lines, pages, lines.select("file", "page", F.explode("spans").alias("s")).select("file", "page", "s.*"), context)
    return items.select(F.col("file").cast("long").alias("l_orderkey"), "item_no", F.element_at("case_keys", 1).alias("case_key"), "petitioner", "respondent", F.size(F.split("raw_text", "\n")).cast("long").alias("lines"))


_HEADS = ("HIGH COURT OF JUDICATURE", "COURT NO. ")
_PLACED = "SELECT *, 'f' || (rn // 150) AS file, (rn % 150) // 15 + 1 AS page, rn % 15 AS r FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS rn FROM part)"


@query(f"""
WITH p AS ({_PLACED}), x AS (SELECT *, 'W.P.No.' || p_partkey || '/2026' AS case_cell, 'PARTY ' || p_size || ' VS THE STATE' AS party, chr(65 + (p_partkey % 26)::INTEGER) || '.' || upper(p_name) AS name FROM p)
SELECT file || ':' || page || ':t:1:' || r AS item_id, (page % 7 + 1)::VARCHAR AS hall, (r + 1)::VARCHAR AS item_no, false AS item_no_inherited, 'WP/' || p_partkey || '/2026' AS case_keys, case_cell AS case_numbers, party AS petitioner, '' AS respondent,
  (r + 1) || '  |  ' || case_cell || '  |  ' || party || '  |  ' || name AS raw_text, 'party=' || party || '; counsel=' || name AS names FROM x
""")
def read_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of spans and rules read as a list: type, columns, hall, serials, cases, parties, names. No page has a roster's name."""
    p = ranked(t(spark, sf, "part", "p_partkey", "p_name", "p_size"), ["p_partkey"], "rn")
    p = p.select("*", F.concat(F.lit("f"), text(F.floor(F.col("rn") / 150))).alias("file"), (F.floor(F.col("rn") % 150 / 15) + 1).cast("int").alias("page"), (F.col("rn") % 15).alias("r"))
    y = lambda r: 700.0 - 40 * r
    cells = [text(F.col("r") + 1), F.concat(F.lit("W.P.No."), text("p_partkey"), F.lit("/2026")), F.concat(F.lit("PARTY "), text("p_size"), F.lit(" VS THE STATE")), F.concat(F.char(F.lit(65) + F.col("p_partkey") % 26), F.lit("."), F.upper("p_name"))]
    span = lambda i, x, c: F.struct((F.col("r") * 4 + i).cast("long").alias("ord"), F.lit(x).alias("x"), F.lit(90.0).alias("w"), c.alias("text"))
    spans = p.select("file", "page", F.explode(F.array(*[span(i, x, c) for i, (x, c) in enumerate(zip((5.0, 55.0, 205.0, 405.0), cells, strict=True))])).alias("s"), (y(F.col("r")) - 20).alias("y")).select("file", "page", "s.ord", "s.x", "y", "s.w", "s.text")
    sheet = p.groupBy("file", "page").agg((F.max("r") + 1).alias("rows"))
    head = lambda i, c: F.struct(F.lit(1000 + i).cast("long").alias("ord"), F.lit(20.0).alias("x"), F.lit(770.0 - 15 * i).alias("y"), F.lit(50.0).alias("w"), c.alias("text"))
    heads = F.array(head(0, F.lit(_HEADS[0])), head(1, F.concat(F.lit(_HEADS[1]), text(F.col("page") % 7 + 1))))
    spans = spans.unionByName(sheet.select("file", "page", F.explode(heads).alias("h")).select("file", "page", "h.*"))
    hsegs = sheet.select("file", "page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows"))).alias("i")).select("file", "page", y(F.col("i")).alias("y"), F.lit(0.0).alias("x0"), F.lit(550.0).alias("x1"))
    vsegs = sheet.select("file", "page", F.explode(F.array(*[F.lit(v) for v in (0.0, 50.0, 200.0, 400.0, 550.0)])).alias("x"), y(F.col("rows")).alias("y0"), F.lit(700.0).alias("y1"))
    pages = sheet.select("file", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(False).alias("was_ocr"))
    roster = spark.createDataFrame([(0, "Q. Zzyzxqv", None)], "advocate_ord int, name string, enrolment string")
    found = extraction.read_documents(pages, spans, hsegs, vsegs, roster)
    names = found["item_names"].groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name_ord", F.concat_ws("=", "match_role", "name").alias("n")))), lambda n: n["n"]), "; ").alias("names"))
    items = found["items"].join(names, "item_id", "left")
    return items.select("item_id", "hall", "item_no", "item_no_inherited", F.array_join("case_keys", ",").alias("case_keys"), F.array_join("case_numbers", ",").alias("case_numbers"), "petitioner", "respondent", "raw_text", "names")


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) - 1 AS line, o_orderkey % 3 = 0 AS dated FROM orders),
d AS (SELECT *, CASE WHEN dated THEN '2026-09-0' || (o_orderkey % 9 + 1) END AS own FROM n WHERE o_orderkey % 5 <> 4)
SELECT 'n' || (o_custkey % 100) AS file, line::BIGINT AS line, 'WP/' || o_orderkey || '/2024' || CASE WHEN o_orderkey % 2 = 0 THEN ',WP/' || (o_orderkey + 1) || '/2024' ELSE '' END AS case_keys,
  last_value(own IGNORE NULLS) OVER w AS reposted_to, CASE WHEN last_value(own IGNORE NULLS) OVER w IS NOT NULL THEN '10.30 a.m.' END AS reposted_time, CASE WHEN dated THEN 'ruled' ELSE 'inferred' END AS date_confidence
FROM d WINDOW w AS (PARTITION BY o_custkey % 100 ORDER BY line ROWS UNBOUNDED PRECEDING)
""")
def line_notices(spark: SparkSession, sf: str) -> DataFrame:
    """Reposted matters from lines of notices; a line without a date takes that of a line before. Lines without a case are none."""
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders", "o_orderkey", "o_custkey").withColumn("g", F.col("o_custkey") % 100)
    o = o.withColumn("line", F.row_number().over(Window.partitionBy("g").orderBy("o_orderkey")) - 1)
    case = F.concat(F.lit("W.P.Nos."), text(k), F.when(k % 2 == 0, F.concat(F.lit(" and "), text(k + 1))).otherwise(""), F.lit("/2024"))
    body = F.when(k % 5 == 4, "no case in this line").otherwise(F.concat(case, F.when(k % 3 == 0, F.concat(F.lit(" stands over to "), text(k % 9 + 1), F.lit(".09.2026 at 10.30 a.m."))).otherwise(" as above")))
    lines = o.select(F.concat(F.lit("n"), text("g")).alias("file"), F.lit(1).alias("page"), "line", body.alias("text"))
    found = extraction.line_notices(lines)
    return found.select("file", (F.col("notice_ord") - 1_000_000).alias("line"), F.array_join("case_keys", ",").alias("case_keys"), "reposted_to", "reposted_time", "date_confidence")


@query("""
SELECT c_custkey AS case_ord, CASE c_custkey % 3 WHEN 0 THEN 'RP/' || c_custkey || '/2022' WHEN 1 THEN 'AP/' || c_custkey || '/2023' END AS case_key, 'D' || c_custkey AS diary_no, c_name AS party_name, c_name || ' -Vs- State' AS cause_title, CASE WHEN c_custkey % 2 = 0 THEN 'Petitioner' END AS counsel_for,
  c_mktsegment AS raw_segment FROM customer
""")
def parse_register(spark: SparkSession, sf: str) -> DataFrame:
    """A register's sheet with its columns in another order and other words: fields, keys from whole numbers or none, and the rest."""
    c, k = t(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey")
    case = F.when(k % 3 == 0, F.concat(F.lit("R.P.No."), text(k), F.lit("/2022"))).when(k % 3 == 1, F.concat(F.lit("ap "), text(k), F.lit(" of 2023"))).otherwise("")
    rows = c.select(k.alias("ord"), F.array(F.col("c_mktsegment"), F.concat("c_name", F.lit(" -Vs- State")), case, F.concat(F.lit("D"), text(k)), F.when(k % 2 == 0, "Petitioner").otherwise(" "), F.col("c_name")).alias("cells"))
    head = spark.createDataFrame([(-1, ["Segment", "Cause Title", "Case Number", "Diary No", "Appearing for", "Client"])], "ord long, cells array<string>")
    found = tabular.parse_register(head.unionByName(rows))
    return found.select("case_ord", "case_key", "diary_no", "party_name", "cause_title", "counsel_for", F.element_at("raw", "Segment").alias("raw_segment"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(upper(p_name), '[^A-Z]', '', 'g') ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey AS advocate_ord, p_name AS name, 'MS/' || p_partkey AS enrolment, CASE WHEN p_partkey % 2 = 0 THEN 'Senior' END AS role FROM r WHERE n = 1
""")
def parse_roster(spark: SparkSession, sf: str) -> DataFrame:
    """A roster's sheet with a serial first and misspelt headings: the first row of each person."""
    k = F.col("p_partkey")
    rows = t(spark, sf, "part", "p_partkey", "p_name").select(k.alias("ord"), F.array(text(k), F.concat(F.lit("MS/"), text(k)), F.concat(F.lit(" "), F.col("p_name")), F.when(k % 2 == 0, "Senior").otherwise("")).alias("cells"))
    head = spark.createDataFrame([(-1, ["S.No", "Enrolmnt No", "Advocat Name", "Designation"])], "ord long, cells array<string>")
    return tabular.parse_roster(head.unionByName(rows))

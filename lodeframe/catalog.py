"""Registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodeframe.functions import bytes as byte_columns, predicates, texts
from lodeframe.operators import classes, datasets, flow, overrides, relations, renames, search, trees, usages as uses
from lodeframe.operators.graph import assignable_to, children, closure, common_ancestors, declared_ancestor, leaves
from lodeframe.operators.lines import lines
from lodeframe.plans.scratch import materialize
from lodeframe.sources.archives import elements_with, elements_without, manifest_changes
from lodeframe.sources.sinks import export_plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) function under ``name`` with its oracle."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    "code_search",
    r"""SELECT full_path, line_no, regexp_replace(line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS match_line FROM (
         SELECT CAST(doc_id AS VARCHAR) AS full_path, unnest(string_split(text, chr(10))) AS line,
                generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
       WHERE contains(lower(line), 'license')""",
)
def code_search(spark: SparkSession, sf: str) -> DataFrame:
    found = lines(table(spark, sf, "documents"), "doc_id", "text").where(F.lower("line").contains("license"))
    return found.select("full_path", F.col("line_no").cast("long").alias("line_no"), predicates.java_trim(F.col("line")).alias("match_line"))


#: Turn n of a conversation points at turn n - 1.
TURNS_SQL = """(SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS src,
                CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR) AS dst FROM conversations
                WHERE turn > (SELECT min(turn) FROM conversations))"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    first = conv.agg(F.min("turn")).first()[0]
    node = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    return conv.where(F.col("turn") > F.lit(first)).select(node(F.col("turn")).alias("src"), node(F.col("turn") - 1).alias("dst"))


@query(
    "hierarchy_closure",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {TURNS_SQL}),
        r(src, dst, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON r.dst = e.src)
        SELECT src, dst, min(depth) AS depth, min(depth) = 1 AS is_direct FROM r GROUP BY src, dst""",
)
def hierarchy_closure(spark: SparkSession, sf: str) -> DataFrame:
    return closure(turns(spark, sf))


@query("hierarchy_leaves", f"SELECT DISTINCT dst AS node FROM {TURNS_SQL} WHERE dst NOT IN (SELECT src FROM {TURNS_SQL})")
def hierarchy_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return leaves(turns(spark, sf))


#: Foreign keys as a hierarchy: customer -> nation -> region.
KEYS_SQL = """(SELECT 'c' || CAST(c_custkey AS VARCHAR) AS src, 'n' || CAST(c_nationkey AS VARCHAR) AS dst FROM customer
               UNION SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier
               UNION SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation)"""


def keys(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda t, a, x, b, y: table(spark, sf, t).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))
    return part("customer", "c", "c_custkey", "n", "c_nationkey").union(part("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(part("nation", "n", "n_nationkey", "r", "n_regionkey"))


@query(
    "common_ancestor",
    f"""WITH e AS (SELECT * FROM {KEYS_SQL}),
        up AS (SELECT src, src AS dst, 0 AS depth FROM e UNION SELECT src, dst, 1 FROM e
               UNION SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src),
        p AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS a, 's' || CAST(l_suppkey AS VARCHAR) AS b
              FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
        m AS (SELECT a, b, x.dst AS ancestor, x.depth + y.depth AS distance,
                     row_number() OVER (PARTITION BY a, b ORDER BY x.depth + y.depth, x.dst) AS k
              FROM p JOIN up x ON p.a = x.src JOIN up y ON p.b = y.src AND x.dst = y.dst)
        SELECT a, b, ancestor, distance FROM m WHERE k = 1""",
)
def common_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = pairs.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    return common_ancestors(closure(keys(spark, sf)), pairs)


@query("children_by_parent", f"SELECT dst AS parent, src AS child, count(*) OVER (PARTITION BY dst) AS n_children FROM {KEYS_SQL}")
def children_by_parent(spark: SparkSession, sf: str) -> DataFrame:
    return children(keys(spark, sf))


@query(
    "assignable_to",
    """SELECT c_custkey, 'c' || CAST(c_custkey AS VARCHAR) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""",
)
def assignable(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("name"))
    return assignable_to(members, "name", keys(spark, sf), "r1").select("c_custkey", "name")


@query(
    "whole_word_search",
    r"""SELECT full_path, line_no, regexp_replace(line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS match_line FROM (
         SELECT CAST(doc_id AS VARCHAR) AS full_path, unnest(string_split(text, chr(10))) AS line,
                generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
       WHERE regexp_matches(lower(line), '(^|[^\p{L}\p{Nd}\p{Nl}\p{Sc}\p{Pc}\p{Mn}\p{Mc}\p{Cf}\x00-\x08\x0E-\x1B\x7F-\x9F])the($|[^\p{L}\p{Nd}\p{Nl}\p{Sc}\p{Pc}\p{Mn}\p{Mc}\p{Cf}\x00-\x08\x0E-\x1B\x7F-\x9F])')""",
)
def whole_word_search(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.text_hits(table(spark, sf, "documents"), "doc_id", "text", "the", whole_word=True)
    return hits.select("full_path", F.col("line_number").cast("long").alias("line_no"), "match_line")


@query(
    "merged_search",
    r"""WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS full_path, 1 AS line_number, p_name AS match_line, 'CLASS' AS match_type, 0 AS type_ordinal
                  FROM part WHERE contains(lower(p_name), 'ring') ORDER BY 1, 2, 3 LIMIT 66),
       d AS (SELECT CAST(doc_id AS VARCHAR) AS full_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
       t AS (SELECT full_path, CAST(n AS INTEGER), regexp_replace(line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), 'CODE_TEXT', 3 FROM d WHERE contains(lower(line), 'ring') ORDER BY 1, 2, 3 LIMIT 66),
       q AS (SELECT url AS full_path, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS n FROM pages),
       s AS (SELECT full_path, CAST(n AS INTEGER) AS n, regexp_replace(line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS l FROM q WHERE contains(lower(line), 'ring') ORDER BY 1, 2, 3 LIMIT 500),
       r AS (SELECT full_path, n, min(l) AS l, 'RESOURCE', 5 FROM s GROUP BY full_path, n ORDER BY 1, 2, 3 LIMIT 66)
       SELECT * FROM (SELECT * FROM c UNION ALL SELECT * FROM t UNION ALL SELECT * FROM r) ORDER BY type_ordinal, line_number, full_path LIMIT 100""",
)
def merged_search(spark: SparkSession, sf: str) -> DataFrame:
    providers = [
        search.name_hits(table(spark, sf, "part"), "p_partkey", "p_name", "ring"),
        search.text_hits(table(spark, sf, "documents"), "doc_id", "text", "ring"),
        search.text_hits(table(spark, sf, "pages"), "url", "html", "ring", "RESOURCE"),
    ]
    return search.merge_hits(providers, 100)


@query("resource_extension", r"""SELECT page_id, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\.([^.]*)$', 1)) AS ext FROM pages""")
def resource_extension(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", predicates.extension(F.col("url")).alias("ext"))


@query("resource_glob", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^.*/[^/]*1[^/]*$')")
def resource_glob(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(predicates.path_glob(F.col("url"), "**/*1*")).select("page_id", "url")


@query("accept_reject", "SELECT p_partkey, p_type FROM part WHERE (starts_with(p_type, 'STANDARD') OR starts_with(p_type, 'PROMO')) AND NOT contains(p_type, 'BRASS')")
def accept_reject(spark: SparkSession, sf: str) -> DataFrame:
    kept = predicates.accepted(F.col("p_type"), ["STANDARD*", "PROMO*"], ["*BRASS*"], predicates.simple_glob)
    return table(spark, sf, "part").where(kept).select("p_partkey", "p_type")


@query("first_wins", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_wins_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    return relations.first_wins(docs, ["content"], ["doc_id"]).select("doc_id")


@query("duplicate_texts", "SELECT sha256(text) AS content, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    return relations.duplicates(table(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("content")), "content")


@query("group_by_package", "SELECT CASE WHEN p > 0 THEN left(url, p) ELSE '' END AS package, count(*) AS n FROM (SELECT url, length(url) - length(regexp_extract(url, '([^/]*)$', 1)) - 1 AS p FROM pages) GROUP BY 1")
def group_by_package(spark: SparkSession, sf: str) -> DataFrame:
    return relations.group_by_package(table(spark, sf, "pages"), "url")


@query("statistics", "SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE (l_linenumber & 2) <> 0) AS flagged FROM lineitem")
def statistics(spark: SparkSession, sf: str) -> DataFrame:
    return relations.statistics(table(spark, sf, "lineitem"), returned=F.col("l_returnflag") == "R", open=F.col("l_linestatus") == "O", flagged=predicates.has_bits(F.col("l_linenumber"), 2))


@query("modifier_filter", "SELECT p_partkey, p_size FROM part WHERE (p_size & 32) <> 0 AND (p_size & 7) = 0")
def modifier_filter(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf, "part").where(predicates.has_bits(size, 32) & predicates.is_package_visible(size)).select("p_partkey", "p_size")


@query("annotated_with_all", "SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3")
def annotated_with_all(spark: SparkSession, sf: str) -> DataFrame:
    return relations.annotated_with_all(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("annotated_with_any", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def annotated_with_any(spark: SparkSession, sf: str) -> DataFrame:
    return relations.annotated_with_any(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"])


def customer_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), (F.col("c_mktsegment") == "BUILDING").alias("is_direct"))
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_totalprice") > 200000).alias("is_direct"))
    return a, b


SETS_SQL = """WITH a AS (SELECT c_custkey AS name, bool_or(c_mktsegment = 'BUILDING') AS d FROM customer GROUP BY 1),
              b AS (SELECT o_custkey AS name, bool_or(o_totalprice > 200000) AS d FROM orders GROUP BY 1) """


@query("set_union", SETS_SQL + "SELECT name, bool_or(d) AS is_direct FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY name")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return relations.union(*customer_sets(spark, sf))


@query("set_intersect", SETS_SQL + "SELECT name, a.d AND b.d AS is_direct FROM a JOIN b USING (name)")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return relations.intersect(*customer_sets(spark, sf))


@query("set_exclude", SETS_SQL + "SELECT name, d AS is_direct FROM a WHERE name NOT IN (SELECT name FROM b)")
def set_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return relations.exclude(*customer_sets(spark, sf))


@query(
    "resolve_members",
    """SELECT user_id, event_type, event_id, n - 1 AS n_hidden FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k,
       count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE k = 1""",
)
def resolve_members(spark: SparkSession, sf: str) -> DataFrame:
    return relations.resolve_members(table(spark, sf, "events").select("user_id", "event_type", "event_id"), "user_id", ["event_type"], ["event_id"])


@query("dependencies", "SELECT l_suppkey AS name, l_partkey AS uses, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WHERE l_suppkey <> l_partkey")
def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return relations.dependencies(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("externals", "SELECT DISTINCT l_partkey AS name FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def externals(spark: SparkSession, sf: str) -> DataFrame:
    return relations.externals(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part").where("p_size < 25"), "p_partkey")


@query("usages", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'bolt')")
def usages(spark: SparkSession, sf: str) -> DataFrame:
    return relations.usages(table(spark, sf, "part"), "p_name", ["ring", "bolt"]).select("p_partkey", "p_name")


@query(
    "nearest_before",
    """SELECT e.event_id, (SELECT max_by(m.event_id, m.event_id) FROM events m WHERE m.user_id = e.user_id AND m.event_type = 'purchase' AND m.event_id <= e.event_id) AS mark
       FROM events e WHERE e.event_type <> 'purchase'""",
)
def nearest_before(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    queries = events.where("event_type <> 'purchase'").select("event_id", "user_id")
    marks = events.where("event_type = 'purchase'").select("event_id", "user_id", F.col("event_id").alias("mark"))
    return relations.nearest_before(queries, marks, "user_id", "event_id", "mark").select("event_id", "mark")


@query("enclosing_regions", "SELECT o_orderkey AS point, p_partkey AS region FROM orders, part WHERE o_orderkey >= p_partkey * 37 AND o_orderkey < p_partkey * 37 + p_size")
def enclosing_regions(spark: SparkSession, sf: str) -> DataFrame:
    regions = table(spark, sf, "part").select(F.col("p_partkey").alias("region"), (F.col("p_partkey") * 37).alias("start"), F.col("p_size").cast("long").alias("length"))
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("point"))
    return relations.enclosing_regions(points, regions, 64).select("point", "region")


@query("cache_trim", "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id DESC) AS run FROM documents) WHERE run <= 1000000")
def cache_trim(spark: SparkSession, sf: str) -> DataFrame:
    return search.running_trim(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 1_000_000, 100_000)


@query(
    "manifest_changes",
    """WITH a AS (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
            b AS (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
       SELECT l_partkey, CASE WHEN a.q IS NULL THEN 'added' WHEN b.q IS NULL THEN 'removed' ELSE 'modified' END AS change
       FROM a FULL JOIN b USING (l_partkey) WHERE a.q IS DISTINCT FROM b.q""",
)
def manifests(spark: SparkSession, sf: str) -> DataFrame:
    listing = lambda flag: table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.max("l_quantity").alias("q"))
    return manifest_changes(listing("R"), listing("A"), "l_partkey", ["q"])


@query("latest_wins", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.latest_wins(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query(
    "upsert",
    """WITH b AS (SELECT o_custkey AS c_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1)
       SELECT c_custkey, cents FROM b UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM b)""",
)
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "customer").select("c_custkey", F.lit(0).cast("long").alias("cents"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return datasets.upsert(old, new, ["c_custkey"])


@query(
    "directory_tree",
    """WITH l AS (SELECT DISTINCT list_filter(regexp_split_to_array(url, '[/:]'), lambda x: x <> '') AS l FROM pages),
       n AS (SELECT l, unnest(range(1, len(l) + 1)) AS d FROM l)
       SELECT array_to_string(l[1:d], '/') AS path, min(array_to_string(l[1:d - 1], '/')) AS parent_path, min(l[d]) AS name,
              CAST(min(d) AS INTEGER) AS depth, bool_and(d = len(l)) AS is_leaf FROM n GROUP BY 1""",
)
def directory_tree(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.directory_tree(table(spark, sf, "pages"), "url")


@query("dot_text", f"""SELECT 'digraph "keys" {{' || chr(10) || string_agg('  "' || src || '" -> "' || dst || '";', chr(10) ORDER BY src, dst) || chr(10) || '}}' AS dot
       FROM (SELECT * FROM {KEYS_SQL} ORDER BY src, dst LIMIT 300)""")
def dot_text(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.dot_text(keys(spark, sf), 300, "keys")


@query(
    "layers",
    f"""WITH RECURSIVE e AS (SELECT * FROM {KEYS_SQL}),
        r(node, layer) AS (SELECT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, layer + 1 FROM r JOIN e ON e.src = r.node)
        SELECT node, max(layer) AS layer FROM r GROUP BY node""",
)
def layers(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.layers(keys(spark, sf))


@query("apply_renames", r"""SELECT doc_id, sha256(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+'),
       lambda x: CASE x WHEN 'license' THEN 'licence' WHEN 'MIT' THEN 'mit_license' ELSE x END), '')) AS renamed FROM documents""")
def apply_renames(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for x in ("license", "licence", "MIT", "mit_license")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(datasets.apply_renames(F.col("text"), names).cast("binary"), 256).alias("renamed"))


def segments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers and nations as classes, market segments as methods: a nation has those of its customers in debt."""
    own = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("owner"), F.col("c_mktsegment").alias("name"))
    above = table(spark, sf, "customer").where("c_acctbal < 0").select(F.concat(F.lit("n"), "c_nationkey").alias("owner"), F.col("c_mktsegment").alias("name"))
    methods = own.union(above.distinct()).withColumns({"descriptor": F.lit("()V"), "modifiers": F.lit(1)})
    return methods, keys(spark, sf).withColumn("rel", F.lit("extends"))


DEBT_SQL = "WITH d AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0) "


@query("overrides", DEBT_SQL + """SELECT 'c' || CAST(c_custkey AS VARCHAR) AS owner, c_mktsegment AS name, '()V' AS descriptor, 'n' || CAST(c_nationkey AS VARCHAR) AS base
       FROM customer JOIN d USING (c_nationkey, c_mktsegment)""")
def override_chain(spark: SparkSession, sf: str) -> DataFrame:
    return overrides.overrides(*segments(spark, sf))


@query("overridden_by", DEBT_SQL + """SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS owner, c_mktsegment AS name, '()V' AS descriptor, 'c' || CAST(c_custkey AS VARCHAR) AS sub
       FROM customer JOIN d USING (c_nationkey, c_mktsegment)""")
def overridden_by(spark: SparkSession, sf: str) -> DataFrame:
    return overrides.overridden_by(*segments(spark, sf))


@query("inherited_methods", DEBT_SQL + """SELECT k AS owner, d.c_mktsegment AS name, '()V' AS descriptor, 'n' || CAST(d.c_nationkey AS VARCHAR) AS base FROM
       (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS k, c_nationkey AS n, c_mktsegment AS s FROM customer
        UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_nationkey, '' FROM supplier) JOIN d ON n = d.c_nationkey AND s <> d.c_mktsegment""")
def inherited_methods(spark: SparkSession, sf: str) -> DataFrame:
    return overrides.inherited(*segments(spark, sf))


@query(
    "export_plan",
    """WITH t AS (SELECT doc_id, source || '/' || coalesce(lang, 'und') || '.txt' AS t FROM documents),
       n AS (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS n FROM t)
       SELECT doc_id, CASE WHEN n = 1 THEN t ELSE replace(t, '.txt', '_' || n || '.txt') END AS target FROM n WHERE t IS NOT NULL""",
)
def exports(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.coalesce("lang", F.lit("und")), F.lit(".txt")).alias("path"))
    return export_plan(docs, "path", "doc_id", "RENAME").where("action = 'write'").select("doc_id", "target")


def typed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Customers extend nations and implement their segment; nations implement regions."""
    rows = lambda rel, t, a, x, b, y, pos: table(spark, sf, t).select(F.lit(rel).alias("rel"), F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"), F.lit(pos).alias("pos"))
    up = rows("extends", "customer", "c", "c_custkey", "n", "c_nationkey", 0)
    return up.union(rows("implements", "customer", "c", "c_custkey", "m", "c_mktsegment", 0)).union(rows("implements", "nation", "n", "n_nationkey", "r", "n_regionkey", 0))


@query("all_interfaces", """SELECT 'c' || c_custkey AS name, 'm' || c_mktsegment AS interface, true AS is_direct FROM customer
       UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, true FROM nation
       UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey, false FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def interfaces_of(spark: SparkSession, sf: str) -> DataFrame:
    return classes.all_interfaces(typed_keys(spark, sf))


@query("override_order", """WITH c AS (SELECT 'c' || c_custkey AS name, 'n' || n_nationkey AS n, 'r' || n_regionkey AS r, 'm' || c_mktsegment AS m FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT name, 0 AS prio, name AS declares FROM c UNION ALL SELECT name, 1, n FROM c UNION ALL SELECT name, 2, r FROM c UNION ALL SELECT name, 3, m FROM c""")
def override_orders(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.lit(False).alias("is_interface"))
    edges = typed_keys(spark, sf)
    up = edges.where("rel = 'implements'").select("dst").distinct().select(F.col("dst").alias("name"), F.lit(True).alias("is_interface"))
    return classes.override_order(edges, kinds.union(up)).where("name LIKE 'c%'")


@query("class_annotations", """WITH d AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS a FROM customer WHERE c_acctbal < 0),
       k AS (SELECT DISTINCT 'c' || c_custkey AS owner, c_mktsegment AS annotation FROM customer)
       SELECT owner, annotation, bool_or(d) AS is_direct FROM (
         SELECT owner, annotation, true AS d FROM k UNION ALL SELECT 'n' || n, a, true FROM d
         UNION ALL SELECT a, 'first ' || left(a, 1), true FROM (SELECT DISTINCT c_mktsegment AS a FROM customer)
         UNION ALL SELECT owner, 'first ' || left(annotation, 1), false FROM k UNION ALL SELECT 'n' || n, 'first ' || left(a, 1), false FROM d
         UNION ALL SELECT 'c' || c_custkey, a, false FROM customer JOIN d ON c_nationkey = n WHERE a IN ('BUILDING', 'MACHINERY')) GROUP BY 1, 2""")
def annotation_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Segments mark customers and nations with a customer in debt, initials mark segments; two segments are inherited."""
    customer = table(spark, sf, "customer")
    own = customer.select(F.concat(F.lit("c"), "c_custkey").alias("owner"), F.col("c_mktsegment").alias("annotation"))
    above = customer.where("c_acctbal < 0").select(F.concat(F.lit("n"), "c_nationkey").alias("owner"), F.col("c_mktsegment").alias("annotation")).distinct()
    meta = customer.select(F.col("c_mktsegment").alias("owner"), F.concat(F.lit("first "), F.substring("c_mktsegment", 1, 1)).alias("annotation")).distinct()
    marks = own.union(above).union(meta).withColumn("target_kind", F.lit("class"))
    inherited = meta.select(F.col("owner").alias("annotation")).where(F.col("annotation").isin("BUILDING", "MACHINERY"))
    return classes.class_annotations(marks, typed_keys(spark, sf), inherited)


@query("visible_members", """WITH m AS (SELECT 'n' || c_nationkey AS owner, c_mktsegment AS name, min(c_custkey) AS pos FROM customer GROUP BY 1, 2),
       o AS (SELECT 'c' || c_custkey AS class_name, 'n' || c_nationkey AS owner FROM customer)
       SELECT class_name, name, owner, pos FROM o JOIN m USING (owner)""")
def members_seen(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("owner"), F.col("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("pos"))
    return classes.visible_members(override_orders(spark, sf), members, ["name"])


@query("find_usages", """SELECT l_orderkey, l_linenumber, owner, name FROM (SELECT l_orderkey, l_linenumber, 'order/' || o_orderpriority AS owner, 'ship' || l_returnflag AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
       WHERE contains(lower(owner), 'order/1-urgent') AND contains(lower(name), 'shipr')""")
def usage_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    refs = rows.select("l_orderkey", "l_linenumber", F.lit("METHOD_CALL").alias("op"), F.concat(F.lit("order/"), "o_orderpriority").alias("owner"), F.concat(F.lit("ship"), "l_returnflag").alias("name"), F.lit("()V").alias("descriptor"))
    return classes.find_usages(refs, "Order.1-URGENT#shipR").drop("op", "descriptor")


@query("byte_search", """WITH p AS (SELECT doc_id, string_split(text, 'license') AS parts FROM documents WHERE text IS NOT NULL),
       i AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM p)
       SELECT CAST(doc_id AS VARCHAR) AS full_path, CAST(strlen(array_to_string(parts[:i], 'license')) AS BIGINT) AS "offset" FROM i""")
def byte_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.byte_hits(table(spark, sf, "documents"), "doc_id", "text", b"license")


@query("quick_open", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def open_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return search.quick_open(table(spark, sf, "part"), "p_name", "Ring").select("p_partkey", "p_name")


@query("preorder", """WITH t AS (SELECT 'r' || r_regionkey AS node, r_regionkey AS r, -1 AS n, -1 AS c FROM region
         UNION ALL SELECT 'n' || n_nationkey, n_regionkey, n_nationkey, -1 FROM nation
         UNION ALL SELECT 'c' || c_custkey, n_regionkey, n_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT node, CASE WHEN c >= 0 THEN 2 WHEN n >= 0 THEN 1 ELSE 0 END AS depth, row_number() OVER (ORDER BY r, n, c) - 1 AS place FROM t""")
def walk(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations and customers as a forest."""
    rows = lambda t, a, x, b, y, at: table(spark, sf, t).select(F.concat(F.lit(a), F.col(x)).alias("node"), (F.concat(F.lit(b), F.col(y)) if y else F.lit(None).cast("string")).alias("parent"), (F.col(x).cast("long") + at).alias("at"))
    nodes = rows("region", "r", "r_regionkey", "", None, 0).union(rows("nation", "n", "n_nationkey", "r", "n_regionkey", 1 << 40)).union(rows("customer", "c", "c_custkey", "n", "c_nationkey", 1 << 41))
    return trees.preorder(nodes, "node", "parent", "at").select("node", "depth", "place")


@query("override_families", DEBT_SQL + """, m AS (SELECT c_nationkey AS n, c_mktsegment AS s, 'c' || c_custkey AS owner FROM customer JOIN d USING (c_nationkey, c_mktsegment)
       UNION ALL SELECT c_nationkey, c_mktsegment, 'n' || c_nationkey FROM d)
       SELECT owner, s AS name, '()V' AS descriptor, min(owner || '.' || s || '()V') OVER (PARTITION BY n, s) AS family FROM m""")
def override_families(spark: SparkSession, sf: str) -> DataFrame:
    return overrides.families(overrides.overrides(*segments(spark, sf)))


@query("member_renames", """WITH f AS (SELECT 'geo/r' || n_regionkey AS owner, n_nationkey AS pos, lower(left(n_name, 2)) AS name FROM nation),
       a AS (SELECT *, 'f' || (row_number() OVER (ORDER BY owner, pos) - 1) || name AS new_name FROM f)
       SELECT owner, name, min_by(new_name, pos) AS new_name FROM a GROUP BY owner, name""")
def renamed_members(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as classes, the first two letters of their nations as fields."""
    fields = table(spark, sf, "nation").select(F.concat(F.lit("geo/r"), "n_regionkey").alias("owner"), F.col("n_nationkey").cast("int").alias("pos"), F.lower(F.substring("n_name", 1, 2)).alias("name"), F.lit("I").alias("descriptor"))
    return renames.member_renames(fields, fields.where("false")).select("owner", "name", "new_name")


@query(
    "byte_values",
    r"""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
         p AS (SELECT doc_id, h, length(h) // 2 AS n, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS le FROM h)
       SELECT doc_id, CASE WHEN n >= 1 THEN CAST('0x' || substr(h, 1, 2) AS BIGINT) END AS uint8,
              CASE WHEN n >= 2 THEN (CAST('0x' || substr(h, 1, 4) AS BIGINT) + 32768) % 65536 - 32768 END AS int16_be,
              CASE WHEN n >= 4 THEN CAST('0x' || le AS BIGINT) END AS uint32_le,
              CASE WHEN n >= 4 THEN (CAST('0x' || le AS BIGINT) + 2147483648) % 4294967296 - 2147483648 END AS int32_le,
              CASE WHEN n >= 8 THEN '#' || substr(h, 9, 8) END AS rgba,
              CASE WHEN n >= 16 THEN lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) END AS guid
       FROM p""",
)
def byte_values(spark: SparkSession, sf: str) -> DataFrame:
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return table(spark, sf, "documents").select(
        "doc_id", byte_columns.unsigned(data, 0, 1).alias("uint8"), byte_columns.signed(data, 0, 2).alias("int16_be"),
        byte_columns.unsigned(data, 0, 4, True).alias("uint32_le"), byte_columns.signed(data, 0, 4, True).alias("int32_le"),
        byte_columns.rgba(data, 4).alias("rgba"), byte_columns.guid(data, 0).alias("guid"),
    )


#: Orders are class path elements, return flags the paths in them.
RESOURCE_SQL = "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey {} (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R')) GROUP BY 1, 2"


@query("elements_with_resource", RESOURCE_SQL.format("IN"))
def elements_with_resource(spark: SparkSession, sf: str) -> DataFrame:
    kept = elements_with(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag"), ["A", "R"], "l_orderkey", "l_returnflag")
    return kept.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))


@query("elements_without_resource", RESOURCE_SQL.format("NOT IN"))
def elements_without_resource(spark: SparkSession, sf: str) -> DataFrame:
    kept = elements_without(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag"), ["A", "R"], "l_orderkey", "l_returnflag")
    return kept.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))


@query(
    "shared_prefix",
    """SELECT order_id, (SELECT count(*) FROM range(1, 1 + least(length(a), length(b))) t(i) WHERE substr(a, 1, i) = substr(b, 1, i)) AS n_prefix,
              (SELECT count(*) FROM range(1, 1 + least(length(a), length(b))) t(i) WHERE right(a, i) = right(b, i)) AS n_suffix
       FROM (SELECT o_orderkey AS order_id, o_orderpriority AS a, CAST(o_orderkey AS VARCHAR) || '-' || o_orderpriority AS b FROM orders)""",
)
def shared_prefix(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("o_orderpriority"), F.concat_ws("-", F.col("o_orderkey").cast("string"), "o_orderpriority")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), texts.common_prefix(a, b).alias("n_prefix"), texts.common_suffix(a, b).alias("n_suffix"))


#: Part names are classes of two parts; parts name them, lines use members of theirs, descriptors mention them.
@query(
    "usage_rules",
    r"""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '/') AS c, split_part(p_name, ' ', 2) AS s FROM part),
         k AS (SELECT *, contains(c, 'small/ring') OR contains('small/ring#user', s) OR contains(s, 'small/ring#user') AS own,
                      regexp_matches('(l' || c || ';)v', 'l([^;]*/)?ring;') AS named FROM p)
       SELECT DISTINCT * FROM (
         SELECT 'part/' || p_partkey AS path, 1 AS line, 'CLASS_REFERENCE' AS type, 'extends ' || c AS text FROM k WHERE own
         UNION ALL SELECT 'part/' || p_partkey, 1, 'METHOD_CALL', 'method make(L' || c || ';)V' FROM k WHERE named
         UNION ALL SELECT 'order/' || l_orderkey, l_linenumber, 'METHOD_CALL', 'invokevirtual ' || c || '.use' || l_returnflag || '()V' FROM lineitem JOIN k ON p_partkey = l_partkey WHERE own)""",
)
def usage_rules(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.translate("p_name", " ", "/").alias("owner"))
    none = F.lit(None).cast("string")
    row = lambda df, path, line, kind, text, rule, owner=none, name=none, descriptor=none: df.select(path.alias("path"), line.cast("int").alias("line"), F.lit(kind).alias("type"), text.alias("text"), F.lit(rule).alias("rule"), owner.alias("owner"), name.alias("name"), descriptor.alias("descriptor"))
    path, used = F.concat(F.lit("part/"), "p_partkey"), F.concat(F.lit("use"), "l_returnflag")
    described = F.concat(F.lit("(L"), "owner", F.lit(";)V"))
    lined = table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    rows = row(part, path, F.lit(1), uses.CLASS, F.concat(F.lit("extends "), "owner"), "class", F.col("owner"))
    rows = rows.unionByName(row(part, path, F.lit(1), uses.CALL, F.concat(F.lit("method make"), described), "descriptor", name=F.lit("make"), descriptor=described))
    rows = rows.unionByName(row(lined, F.concat(F.lit("order/"), "l_orderkey"), F.col("l_linenumber"), uses.CALL, F.concat(F.lit("invokevirtual "), "owner", F.lit("."), used, F.lit("()V")), "member", F.col("owner"), used, F.lit("()V")))
    return uses.search_usages(rows, "small.ring#useR")


#: Suppliers extend nations, which implement regions. A line of an order calls a method of its supplier, reads a field of it, and
#: calls one constructor that all lines call.
@query(
    "use_graph",
    """WITH s AS (SELECT s_suppkey AS s, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
       own AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS f FROM lineitem WHERE l_returnflag = 'A'),
       l AS (SELECT l_orderkey || '.' || l_linenumber AS who, s.*, l_linenumber AS f, l_returnflag AS g FROM lineitem JOIN s ON s = l_suppkey),
       u AS (SELECT who, 'call' AS kind, CASE WHEN own.s IS NOT NULL THEN 's' || l.s WHEN l.f = n % 7 + 1 THEN 'n' || n WHEN l.f = r + 1 THEN 'r' || r END AS target, 'f' || l.f AS target_member
               FROM l LEFT JOIN own ON own.s = l.s AND own.f = l.f
             UNION ALL SELECT who, 'field', CASE WHEN g <> 'R' THEN 'r' || r END, 'g' || g FROM l
             UNION ALL SELECT who, 'call', 'root', '<init>' FROM l)
       SELECT kind, target, target_member, count(DISTINCT who) AS n_users, count(*) AS n_uses FROM u GROUP BY 1, 2, 3""",
)
def use_graph(spark: SparkSession, sf: str) -> DataFrame:
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    supplier, nation, region, line = (table(spark, sf, t) for t in ("supplier", "nation", "region", "lineitem"))
    up = supplier.select(F.lit("extends").alias("rel"), named("s", "s_suppkey").alias("src"), named("n", "s_nationkey").alias("dst"), F.lit(0).alias("pos"))
    edges = up.unionByName(nation.select(F.lit("implements").alias("rel"), named("n", "n_nationkey").alias("src"), named("r", "n_regionkey").alias("dst"), F.lit(0).alias("pos")))
    kinds = edges.select(F.col("src").alias("name"), F.lit(False).alias("is_interface")).union(region.select(named("r", "r_regionkey"), F.lit(True)))
    roots = supplier.select(named("s", "s_suppkey").alias("name"))
    nothing = F.lit("()V").alias("descriptor")
    methods = line.where("l_returnflag = 'A'").select(named("s", "l_suppkey").alias("owner"), named("f", "l_linenumber").alias("name"), nothing).distinct()
    methods = methods.unionByName(nation.select(named("n", "n_nationkey").alias("owner"), F.concat(F.lit("f"), F.col("n_nationkey") % 7 + 1).alias("name"), nothing))
    methods = methods.unionByName(region.select(named("r", "r_regionkey").alias("owner"), F.concat(F.lit("f"), F.col("r_regionkey") + 1).alias("name"), nothing))
    methods = methods.unionByName(region.limit(1).select(F.lit("root").alias("owner"), F.lit("<init>").alias("name"), nothing))
    fields = region.select(named("r", "r_regionkey").alias("owner"), F.explode(F.array(F.lit("gA"), F.lit("gN"))).alias("name"), nothing)
    who = (named("o", "l_orderkey").alias("src"), named("m", "l_linenumber").alias("member"))
    of = lambda kind, owner, name: line.select(*who, F.lit(kind).alias("kind"), owner.alias("owner"), name.alias("name"), nothing)
    made = of("call", named("s", "l_suppkey"), named("f", "l_linenumber")).unionByName(of("field", named("s", "l_suppkey"), named("g", "l_returnflag"))).unionByName(of("call", F.lit("root"), F.lit("<init>")))
    orders = [classes.override_order(edges, kinds, fields=f, roots=roots) for f in (False, True)]
    found = uses.resolve_uses(made, orders[0], methods, orders[1], fields)
    return found.groupBy("kind", F.col("declared_in").alias("target"), F.col("name").alias("target_member")).agg(F.count_distinct("src", "member").alias("n_users"), F.count("*").alias("n_uses"))


#: Customers are methods, their lines instructions by order: one in six each jumps, branches, returns or switches. A handler covers
#: the first half of each.
FLOW_SQL = """WITH i AS (SELECT o_custkey AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
            count(*) OVER (PARTITION BY o_custkey) AS n, l_partkey % 6 AS k, l_partkey AS p, l_suppkey AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
     j AS (SELECT m, pos, k, s % n AS t, p % n AS u FROM i),
     h AS (SELECT DISTINCT m, 0 AS low, n // 2 AS high, m % n AS handler, CASE WHEN m % 3 = 0 THEN 'any' ELSE 'E' || (m % 3) END AS label FROM i),
     leads AS (SELECT m, t AS pos FROM j WHERE k IN (0, 1, 3) UNION SELECT m, u FROM j WHERE k = 3 UNION SELECT m, 0 FROM j UNION SELECT m, handler FROM h),
     x AS (SELECT j.*, CASE WHEN leads.m IS NOT NULL OR lag(k IN (1, 2, 3)) OVER (PARTITION BY j.m ORDER BY j.pos) THEN 1 ELSE 0 END AS b FROM j LEFT JOIN leads ON leads.m = j.m AND leads.pos = j.pos),
     y AS (SELECT *, sum(b) OVER (PARTITION BY m ORDER BY pos) - 1 AS block FROM x),
     z AS (SELECT m, CAST(block AS INTEGER) AS block, min(pos) AS first, max(pos) AS last, max_by(k, pos) AS k, max_by(t, pos) AS t, max_by(u, pos) AS u FROM y GROUP BY 1, 2)
"""


def flow_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.select(F.col("o_custkey").alias("m"), (F.row_number().over(order) - 1).alias("at"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    rows = materialize(rows, "rows")
    k, goal = F.col("p") % 6, lambda label, at: F.struct(label.cast("string").alias("label"), at.cast("int").alias("offset"))
    to, none = goal(F.lit(None), F.col("s") % F.col("n")), F.array().cast("array<struct<label:string,offset:int>>")
    cases = F.array(goal(F.lit("1"), F.col("s") % F.col("n")), goal(F.lit("2"), F.col("p") % F.col("n")), goal(F.lit("default"), F.lit(0)))
    op = F.when(k == 0, "goto").when(k == 1, "ifeq").when(k == 2, "ireturn").when(k == 3, "tableswitch").otherwise("nop")
    kind = F.when(k < 2, "jump").when(k == 3, "switch").otherwise("plain")
    code = rows.select("m", "at", F.col("at").alias("offset"), op.alias("op"), kind.alias("kind"), F.when(k < 2, F.array(to)).when(k == 3, cases).otherwise(none).alias("targets"))
    part = F.col("m") % 3
    handlers = rows.groupBy("m").agg(F.max("n").alias("n")).select("m", F.lit(0).alias("start"), F.floor(F.col("n") / 2).cast("int").alias("end"), (F.col("m") % F.col("n")).cast("int").alias("handler"),
                                                                   F.when(part != 0, F.concat(F.lit("java/lang/E"), part)).alias("type"))
    return code, handlers


@query("basic_blocks", FLOW_SQL + "SELECT m, block, first, last, CASE k WHEN 0 THEN 'goto' WHEN 1 THEN 'ifeq' WHEN 2 THEN 'ireturn' WHEN 3 THEN 'tableswitch' ELSE 'nop' END AS op FROM z")
def basic_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return flow.basic_blocks(*flow_tables(spark, sf), by=["m"]).select("m", "block", "first", "last", "op")


@query(
    "flow_edges",
    FLOW_SQL
    + """, e AS (SELECT z.m, z.block AS src, o.block AS dst, CASE z.k WHEN 0 THEN '' ELSE 'true' END AS label, CASE z.k WHEN 0 THEN 'solid' ELSE 'dashed' END AS style FROM z JOIN z o ON o.m = z.m AND o.first = z.t WHERE z.k IN (0, 1)
       UNION ALL SELECT z.m, z.block, o.block, CASE z.k WHEN 1 THEN 'false' ELSE '' END, CASE z.k WHEN 1 THEN 'dashed' ELSE 'solid' END FROM z JOIN z o ON o.m = z.m AND o.block = z.block + 1 WHERE z.k IN (1, 4, 5)
       UNION ALL SELECT z.m, z.block, o.block, CASE WHEN z.t = z.u THEN '2 cases' ELSE 'case' END, 'dashed' FROM z JOIN z o ON o.m = z.m AND o.first = z.t WHERE z.k = 3
       UNION ALL SELECT z.m, z.block, o.block, 'case', 'dashed' FROM z JOIN z o ON o.m = z.m AND o.first = z.u WHERE z.k = 3 AND z.t <> z.u
       UNION ALL SELECT m, block, 0, 'default', 'dashed' FROM z WHERE k = 3
       UNION ALL SELECT z.m, z.block, o.block, h.label, 'dotted' FROM z JOIN h ON h.m = z.m JOIN z o ON o.m = z.m AND o.first = h.handler WHERE z.first <= h.high AND z.last >= h.low)
       SELECT m, src, dst, label, style, count(*) AS n FROM e GROUP BY ALL""",
)
def flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    code, handlers = flow_tables(spark, sf)
    edges = flow.flow_edges(flow.basic_blocks(code, handlers, by=["m"]), handlers, by=["m"])
    return edges.groupBy("m", "src", "dst", "label", "style").agg(F.count("*").alias("n"))


#: Parts are nested regions: a quarter of their sizes is long enough to hold others.
@query(
    "region_paths",
    """WITH r AS (SELECT p_partkey AS region, p_partkey * 3 AS start, CASE WHEN p_size % 4 = 0 THEN p_size * 8 ELSE p_size END AS length FROM part),
       m AS (SELECT o_orderkey AS point, region, length FROM orders, r WHERE o_orderkey >= start AND o_orderkey < start + length)
       SELECT point, CAST(count(*) AS INTEGER) AS n_regions, string_agg(CAST(region AS VARCHAR), ' > ' ORDER BY length DESC, region DESC) AS path,
              CAST(arg_min(region, CAST(length AS BIGINT) * 100000000 + region) AS VARCHAR) AS innermost FROM m GROUP BY point""",
)
def region_paths(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("p_size") % 4 == 0, F.col("p_size") * 8).otherwise(F.col("p_size")).cast("long")
    regions = table(spark, sf, "part").select(F.col("p_partkey").alias("region"), (F.col("p_partkey") * 3).alias("start"), size.alias("length"))
    return relations.region_paths(table(spark, sf, "orders").select(F.col("o_orderkey").alias("point")), regions, 64)


@query("nearest_after", """SELECT a.event_id, (SELECT arg_min(b.event_type, b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_id > a.event_id AND b.value > 50) AS mark FROM events a""")
def nearest_after(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    marks = events.where("value > 50").select("user_id", "event_id", F.col("event_type").alias("mark"))
    return relations.nearest_after(events.select("user_id", "event_id"), marks, "user_id", "event_id", "mark").select("event_id", "mark")


#: Customers extend a segment, then a nation; suppliers a nation; nations a region.
@query(
    "declared_ancestor",
    """WITH p AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
       x AS (SELECT c, s, c.n_nationkey AS cn, c.n_regionkey AS cr, d.n_nationkey AS sn, d.n_regionkey AS sr FROM p JOIN customer ON c_custkey = c JOIN nation c ON c.n_nationkey = c_nationkey
             JOIN supplier ON s_suppkey = s JOIN nation d ON d.n_nationkey = s_nationkey)
       SELECT 'c' || c AS a, 's' || s AS b, CASE WHEN cn = sn THEN 'n' || sn WHEN cr = sr THEN 'r' || sr END AS ancestor FROM x""",
)
def ancestors_declared(spark: SparkSession, sf: str) -> DataFrame:
    up = lambda t, a, x, b, y, pos: table(spark, sf, t).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"), F.lit(pos).alias("pos"))
    edges = up("customer", "c", "c_custkey", "m", "c_mktsegment", 0).union(up("customer", "c", "c_custkey", "n", "c_nationkey", 1)).union(up("supplier", "s", "s_suppkey", "n", "s_nationkey", 0)).union(up("nation", "n", "n_nationkey", "r", "n_regionkey", 0))
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return declared_ancestor(edges, rows.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")))

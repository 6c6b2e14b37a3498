"""The engine's registered queries and the SQL that each is checked against."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.operators import media, relational, spatial, text, vectors
from quarry.sources import ingest

QUERIES: dict = {}
ORACLES: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(name: str, build, oracle: str | None = None) -> None:
    QUERIES[name] = build
    if oracle:
        ORACLES[name] = oracle


def _scratch(spark: SparkSession) -> str:
    """A folder for tables that a query writes: the shared one, else a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    import uuid

    return f"{folder.rstrip('/')}/quarry-{uuid.uuid4().hex}" if folder else "file://" + tempfile.mkdtemp(prefix="quarry-")


def _sql(name: str, table: str, key: str, statement: str, oracle: str) -> None:
    """A statement of the dialect over one table."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, _scratch(spark), text.PLAIN)
        engine.register(table, _table(spark, sf_dir, table), key)
        return engine.execute(statement).df

    _register(name, build, oracle)


_sql("scan_all", "nation", "n_nationkey", "SELECT * FROM nation", "SELECT * FROM nation")
_sql("project_cols", "customer", "c_custkey", "SELECT c_custkey, c_name FROM customer", "SELECT c_custkey, c_name FROM customer")
_sql("pk_lookup", "orders", "o_orderkey", "SELECT * FROM orders WHERE o_orderkey = 42", "SELECT * FROM orders WHERE o_orderkey = 42")
_sql("pk_range", "orders", "o_orderkey", "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 199", "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 199")
_sql("eq_nonpk", "customer", "c_custkey", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
_sql("range_nonpk", "part", "p_partkey", "SELECT * FROM part WHERE p_retailprice BETWEEN 900 AND 950", "SELECT * FROM part WHERE p_retailprice BETWEEN 900 AND 950")
for _name, _op in (("ne", "!="), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">=")):
    _sql(f"cmp_{_name}", "part", "p_partkey", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 25", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 25")
_sql("cmp_combined", "part", "p_partkey", "SELECT p_partkey FROM part WHERE p_size > 10 AND (p_brand = 'Brand#11' OR NOT p_size < 40)", "SELECT p_partkey FROM part WHERE p_size > 10 AND (p_brand = 'Brand#11' OR NOT p_size < 40)")
for _name, _where in (
    ("out_of_range", "p_size < 99999999999 AND p_size != 99999999999 AND p_partkey > -99999999999"),
    ("in_list", "p_size IN (3, 7, 49) AND p_brand NOT IN ('Brand#11', 'Brand#12')"),
    ("like", "p_type LIKE '%BRASS%' OR p_name NOT LIKE '%a%'"),
    ("is_null", "p_size IS NOT NULL AND NOT p_brand IS NULL"),
):
    _sql(f"cmp_{_name}", "part", "p_partkey", f"SELECT p_partkey FROM part WHERE {_where}", f"SELECT p_partkey FROM part WHERE {_where}")
for _name, _tail in (("order_by", "ORDER BY c_mktsegment DESC, c_custkey LIMIT 40"), ("offset_page", "ORDER BY c_custkey LIMIT 5 OFFSET 35")):
    _sql(_name, "customer", "c_custkey", f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey > 3 {_tail}", f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey > 3 {_tail}")
_sql("top_n", "orders", "o_orderkey", "SELECT TOP 25 FROM orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25")
_sql("get_len", "lineitem", "l_orderkey", "get_len(lineitem)", "SELECT count(*) AS count FROM lineitem")
_sql("count_where", "lineitem", "l_orderkey", "SELECT COUNT(*) FROM lineitem WHERE l_quantity >= 10", "SELECT count(*) AS count FROM lineitem WHERE l_quantity >= 10")

_register("describe_stats", lambda s, d: relational.describe(_table(s, d, "supplier")).select("column", "rows", "nulls").filter("column LIKE 's_%'"),
          "SELECT * FROM (VALUES ('s_suppkey'), ('s_name'), ('s_nationkey'), ('s_acctbal')) c(\"column\"), (SELECT count(*) AS rows, 0::BIGINT AS nulls FROM supplier)")
_LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
_register("describe_all", lambda s, d: relational.describe(_table(s, d, "lineitem")).select("column", "rows", "nulls", *[F.regexp_replace(c, r"^-0\.0$", "0.0").alias(c) for c in ("least", "greatest")]),
          " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, regexp_replace(min({c})::VARCHAR, '^-0[.]0$', '0.0') AS least, regexp_replace(max({c})::VARCHAR, '^-0[.]0$', '0.0') AS greatest FROM lineitem"
                             for c in _LINE))


def _managed(spark: SparkSession, sf_dir: str, table: str, ddl: str, analyzer: text.Analyzer = text.PLAIN) -> Engine:
    """An engine whose table holds the rows of one of the test tables, by column name."""
    engine = Engine(spark, _scratch(spark), analyzer)
    engine.execute(f"CREATE TABLE {table} ({ddl})")
    engine.insert(table, _table(spark, sf_dir, table))
    return engine


def _written(table: str, ddl: str, *writes):
    """The table after writes through the catalog: statements, or functions of the engine."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _managed(spark, sf_dir, table, ddl)
        for w in writes:
            engine.execute(w) if isinstance(w, str) else w(engine)
        return engine.table(table)

    return build


_NATION = "n_nationkey INT KEY INDEX BTREE, n_name VARCHAR(25), n_regionkey INT"
_register("insert_row", _written("region", "r_regionkey INT KEY, r_name VARCHAR(25)", "INSERT INTO region VALUES (99, 'ATLANTIS'), (100, 'LEMURIA')"),
          "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS' UNION ALL SELECT 100, 'LEMURIA'")
_register("delete_by_pk", _written("nation", _NATION, "DELETE FROM nation WHERE n_nationkey = 3", "DELETE FROM nation WHERE n_nationkey = 1234"), "SELECT * FROM nation WHERE n_nationkey <> 3")
_register("update_row", _written("nation", _NATION, lambda e: e.update("nation", 3, {"n_name": "NOWHERE"})),
          "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'NOWHERE' ELSE n_name END AS n_name, n_regionkey FROM nation")
_register("table_stats", lambda s, d: _managed(s, d, "nation", _NATION).stats("nation").select("kind", F.explode("figures").alias("figure", "value")),
          "SELECT 'table' AS kind, unnest(['rows', 'keys', 'parts']) AS figure, unnest([count(*), count(DISTINCT n_nationkey), 1])::DOUBLE AS value FROM nation")


def _mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE, two INSERTs, a DELETE and a SELECT through the catalog."""
    engine = Engine(spark, _scratch(spark), text.PLAIN)
    for sql in ("CREATE TABLE spots (id INT KEY INDEX BTREE, name VARCHAR(20), at POINT)", "INSERT INTO spots VALUES (0, 'zero', (0, 0))",
                "INSERT INTO spots VALUES (1, 'one', POINT(3 4))", "INSERT INTO spots VALUES (2, 'two', NULL)", "DELETE FROM spots WHERE id = 2"):
        engine.execute(sql)
    return engine.execute("SELECT * FROM spots").df


_register("sql_mutations", _mutations, "SELECT * FROM (VALUES (0, 'zero', 'POINT(0 0)'), (1, 'one', 'POINT(3 4)')) t(id, name, \"at\")")


def _loaded(kind: str, table: str, key: str):
    """The table written as a file and loaded again by the statement."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _scratch(spark)
        ingest.export(_table(spark, sf_dir, table), f"{folder}/{table}.{kind}")
        engine = Engine(spark, f"{folder}/db", text.PLAIN)
        engine.execute(f"CREATE TABLE loaded FROM FILE '{folder}/{table}.{kind}' USING INDEX hash('{key}')")
        return engine.table("loaded")

    return build


def _loaded_file(rows, ending: str, key: str):
    """A file of one string a line that is made of a table's rows, loaded by the statement."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _scratch(spark)
        rows(spark, sf_dir).coalesce(1).write.text(f"{folder}/file.{ending}")
        engine = Engine(spark, f"{folder}/db", text.PLAIN)
        engine.execute(f"CREATE TABLE loaded FROM FILE '{folder}/file.{ending}' USING INDEX seq('{key}')")
        return engine.table("loaded")

    return build


_register("csv_load", _loaded("csv", "customer", "c_custkey"), "SELECT * FROM customer")
_register("json_load", _loaded("json", "supplier", "s_suppkey"), "SELECT s_acctbal, s_name, s_nationkey, s_suppkey FROM supplier")
_register("json_array_load", _loaded_file(lambda s, d: _table(s, d, "nation").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value")), "json", "n_nationkey"),
          "SELECT n_nationkey, n_name FROM nation")
_TAIL = "CASE WHEN p_partkey > 1500 THEN repeat(p_name, 5) ELSE p_name END"
_register("csv_wide_tail", _loaded_file(lambda s, d: s.createDataFrame([(0, "id,name")], "k long, value string").unionByName(
              _table(s, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.expr(f"concat(p_partkey, ',', {_TAIL})").alias("value"))).orderBy("k").select("value"), "csv", "id"),
          f"SELECT p_partkey::INT AS id, {_TAIL} AS name FROM part")

# text
_NORM = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[ \t\n\r\f]+'), lambda w: w <> '')"
_TOKENS = f"d AS (SELECT doc_id, lang, {_NORM} AS w FROM documents)"
_RANK = f"""WITH {_TOKENS}, q AS (SELECT * FROM (VALUES @TERMS@) v(t)), p AS (SELECT doc_id, lang, t, len(list_filter(w, lambda x: x = t)) AS tf FROM d, q),
n AS (SELECT count(*) AS n FROM documents WHERE length(trim(text)) > 0), f AS (SELECT t, ln(n / count(*)) AS idf FROM p, n WHERE tf > 0 GROUP BY t, n)
SELECT doc_id, round(sum(tf * idf), 6) AS score FROM p JOIN f USING (t) GROUP BY doc_id HAVING sum(tf) > 0 ORDER BY sum(tf * idf) DESC, doc_id LIMIT @K@"""


def _ranked(query: str, k: int):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, _scratch(spark), text.PLAIN)
        engine.register("documents", _table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
        return engine.execute(f"SELECT doc_id, _score FROM documents WHERE text RANKED BY '{query}' LIMIT {k}").df.select("doc_id", F.round("_score", 6).alias("score"))

    return build


def _rank_sql(query: str, k: int) -> str:
    return _RANK.replace("@TERMS@", ", ".join(f"('{t}')" for t in query.split())).replace("@K@", str(k))


_register("text_ranked", _ranked("anwh ones hent", 10), _rank_sql("anwh ones hent", 10))
_register("text_multiword", _ranked("reing tion nicht", 100), _rank_sql("reing tion nicht", 100))
for _name, _query, _where in (
    ("text_contains_term", "anwh", "list_contains(w, 'anwh')"),
    ("text_contains_and", "anwh AND ones", "list_contains(w, 'anwh') AND list_contains(w, 'ones')"),
    ("text_contains_or", "anwh OR nicht", "list_contains(w, 'anwh') OR list_contains(w, 'nicht')"),
    ("text_mixed", "anwh AND ones OR nicht", "list_contains(w, 'anwh') AND list_contains(w, 'ones') OR list_contains(w, 'nicht')"),
    ("text_not", "NOT anwh", "NOT list_contains(w, 'anwh')"),
):
    _sql(_name, "documents", "doc_id", f"SELECT doc_id, lang FROM documents WHERE text CONTAINS '{_query}'", f"WITH {_TOKENS} SELECT doc_id, lang FROM d WHERE {_where}")
_sql("text_phrase", "documents", "doc_id", "SELECT doc_id FROM documents WHERE text PHRASE 'of the'",
     f"WITH {_TOKENS}, p AS (SELECT doc_id, unnest(w) AS a, unnest(list_append(w[2:], '')) AS b FROM d) SELECT DISTINCT doc_id FROM p WHERE a = 'of' AND b = 'the'")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.postings(_table(spark, sf_dir, "documents"), "doc_id", "text")


_POST = f"WITH {_TOKENS}, p AS (SELECT doc_id AS doc, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d), i AS (SELECT term, doc, count(*) AS tf, min(pos) AS first FROM p GROUP BY 1, 2)"
_register("text_postings", lambda s, d: _postings(s, d).filter(F.col("term").isin("anwh", "ones")).select("term", "doc", "tf", F.col("positions")[0].cast("long").alias("first")),
          _POST + " SELECT term, doc, tf, first FROM i WHERE term IN ('anwh', 'ones')")
_register("text_postings_all", lambda s, d: _postings(s, d).select("term", "doc", "tf", F.md5(F.array_join(F.col("positions").cast("array<string>"), ",").cast("binary")).alias("positions")),
          f"WITH {_TOKENS}, p AS (SELECT doc_id AS doc, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d)"
          " SELECT term, doc, count(*) AS tf, md5(string_agg(pos::VARCHAR, ',' ORDER BY pos)) AS positions FROM p GROUP BY 1, 2")  # fmt: skip
_register("text_top_terms", lambda s, d: text.top_terms(_table(s, d, "documents"), "text"), _POST + " SELECT term, count(*) AS df FROM i GROUP BY 1 ORDER BY df DESC, term LIMIT 10")


def _with_n(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents")
        return build(_postings(spark, sf_dir), docs.filter(F.length(F.trim("text")) > 0).count())

    return run


_N = ", n AS (SELECT count(*) AS n FROM documents WHERE length(trim(text)) > 0), f AS (SELECT term, count(*) AS df FROM i GROUP BY 1), v AS (SELECT doc, term, tf * ln(n / df) AS x FROM i JOIN f USING (term), n)"
_register("text_tfidf", _with_n(lambda i, n: text.tf_idf(i, n).filter("term = 'anwh'").select("doc", "term", F.round("tf_idf", 6).alias("tf_idf"))),
          _POST + _N + " SELECT doc, term, round(x, 6) AS tf_idf FROM v WHERE term = 'anwh'")
_register("text_tfidf_all", _with_n(lambda i, n: text.tf_idf(i, n).select("doc", "term", F.round("tf_idf", 6).alias("tf_idf"))), _POST + _N + " SELECT doc, term, round(x, 6) AS tf_idf FROM v")
_register("text_ranked_cosine", _with_n(lambda i, n: text.ranked_cosine(i, "anwh ones hent", n).select("doc", F.round("_score", 6).alias("score"))),
          _POST + _N + ", l AS (SELECT doc, sqrt(sum(x * x)) AS l FROM v GROUP BY 1), q AS (SELECT term, ln(n / df) AS q FROM f, n WHERE term IN ('anwh', 'ones', 'hent'))"
          " SELECT doc, round(sum(x * q) / (any_value(l) * (SELECT sqrt(sum(q * q)) FROM q)), 6) AS score FROM v JOIN q USING (term) JOIN l USING (doc) GROUP BY doc ORDER BY sum(x * q) / any_value(l) DESC, doc LIMIT 10")  # fmt: skip
# all words of the tables whose stem is er or on
_ER, _ON = "['er', 'ers', 'ere', 'eres', 'ered', 'ering', 'ereds', 'erings']", "['on', 'ons', 'one', 'ones', 'oned', 'oning', 'oneds', 'onings']"
_register("text_stemmed", lambda s, d: text.contains(_table(s, d, "documents"), "doc_id", "text", "ering AND oned", text.Analyzer()).select("doc_id"),
          f"WITH {_TOKENS} SELECT doc_id FROM d WHERE list_has_any(w, {_ER}) AND list_has_any(w, {_ON})")


def _indexed(statement: str, *columns: str, analyzer: text.Analyzer = text.PLAIN):
    """A statement over documents in a table with a text index, half of whose rows came before it and half after."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, _scratch(spark), analyzer)
        engine.execute("CREATE TABLE documents (doc_id INT KEY, text VARCHAR(100000000))")
        docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
        engine.insert("documents", docs.filter("doc_id % 2 = 0"))
        engine.execute("CREATE INVERTED INDEX words ON documents (text)")
        engine.insert("documents", docs.filter("doc_id % 2 = 1"))
        engine.execute("INSERT INTO documents VALUES (-1, 'anwh anwh anwh')")
        engine.execute("DELETE FROM documents WHERE doc_id = -1")
        return engine.execute(statement).df.selectExpr(*columns)

    return build


_ID = "CAST(doc_id AS BIGINT) AS doc_id"
_register("text_index_ranked", _indexed("SELECT doc_id, _score FROM documents WHERE text RANKED BY 'anwh ones hent' LIMIT 10", _ID, "round(_score, 6) AS score"), _rank_sql("anwh ones hent", 10))
_register("text_index_mixed", _indexed("SELECT doc_id FROM documents WHERE text CONTAINS 'anwh AND ones OR NOT hent'", _ID),
          f"WITH {_TOKENS} SELECT doc_id FROM d WHERE list_contains(w, 'anwh') AND list_contains(w, 'ones') OR NOT list_contains(w, 'hent')")
_register("text_index_stemmed", _indexed("SELECT doc_id FROM documents WHERE text CONTAINS 'ering AND oned'", _ID, analyzer=text.Analyzer()), ORACLES["text_stemmed"])


# space: points of customers, boxes of parts
def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.format_string("POINT(%s %s)", F.col("c_acctbal").cast("string"), F.col("c_custkey").cast("string")).alias("at"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_size"), F.col("p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", F.format_string("POLYGON((%d %d, %d %d, %d %d, %d %d, %d %d))", x, y, x + 5, y, x + 5, y + 5, x, y + 5, x, y).alias("area"))


def _space(source, table: str, key: str, statement: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, _scratch(spark), text.PLAIN)
        engine.register(table, source(spark, sf_dir), key)
        return engine.execute(statement).df

    return build


_PART = "(SELECT p_partkey, p_size AS x0, p_partkey AS y0, p_size + 5 AS x1, p_partkey + 5 AS y1 FROM part)"
for _name, _form in (("spatial_within", "WITHIN ((100, 200), 400)"), ("spatial_within_in", "IN ((100, 200), 400)")):
    _register(_name, _space(_points, "spots", "c_custkey", f"SELECT c_custkey FROM spots WHERE at {_form}"), "SELECT c_custkey FROM customer WHERE sqrt((c_acctbal - 100) ** 2 + (c_custkey - 200) ** 2) <= 400")
_register("spatial_in_range", _space(_points, "spots", "c_custkey", "SELECT c_custkey FROM spots WHERE at IN_RANGE ((0, 0), (2000, 500))"), "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 2000 AND c_custkey BETWEEN 0 AND 500")
_register("spatial_nearest", _space(_points, "spots", "c_custkey", "SELECT c_custkey FROM spots WHERE at NEAREST (1000, 100) LIMIT 10"), "SELECT c_custkey FROM customer ORDER BY sqrt((c_acctbal - 1000) ** 2 + (c_custkey - 100) ** 2), c_custkey LIMIT 10")
_register("spatial_intersects", _space(_boxes, "areas", "p_partkey", "SELECT p_partkey FROM areas WHERE area INTERSECTS (10, 50, 20, 120)"), f"SELECT p_partkey FROM {_PART} WHERE x0 <= 20 AND x1 >= 10 AND y0 <= 120 AND y1 >= 50")
_register("spatial_rect_distance", _space(_boxes, "areas", "p_partkey", "SELECT p_partkey FROM areas WHERE area WITHIN ((12, 60), 8)"), f"SELECT p_partkey FROM {_PART} WHERE sqrt(greatest(x0 - 12, 0, 12 - x1) ** 2 + greatest(y0 - 60, 0, 60 - y1) ** 2) <= 8")
_register("spatial_bounds", lambda s, d: spatial.extent(_boxes(s, d), "area"), f"SELECT count(*) AS geometries, min(x0)::DOUBLE AS minx, min(y0)::DOUBLE AS miny, max(x1)::DOUBLE AS maxx, max(y1)::DOUBLE AS maxy FROM {_PART}")


# vectors: embeddings, and sets of them as local descriptors of 50 documents
def _vec_zero(spark: SparkSession, sf_dir: str) -> list[float]:
    return _table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vec_zero(spark, sf_dir), 10)


_register("vec_knn_exact", lambda s, d: _knn(s, d).select("vec_id", F.abs(F.round("_similarity_distance", 6)).alias("distance"), F.round("_similarity_score", 6).alias("score")),
          "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, list_cosine_distance(embedding::DOUBLE[], q) AS d FROM embeddings, q) SELECT vec_id, abs(round(d, 6)) AS distance, round(1 / (1 + d), 6) AS score FROM x ORDER BY d, vec_id LIMIT 10")
_register("sim_mean", lambda s, d: vectors.mean_similarity(_knn(s, d)).select(F.round("mean_similarity", 6).alias("mean_similarity")),
          "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, list_cosine_distance(embedding::DOUBLE[], q) AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 10) SELECT round(avg(1 / (1 + d)), 6) AS mean_similarity FROM x")
_register("vec_distance", lambda s, d: vectors.distance(_table(s, d, "embeddings"), "vec_id", "embedding", 3, 5).select(F.round("_similarity_distance", 6).alias("distance")),
          "SELECT round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id = 5")
_register("sim_confidence", lambda s, d: vectors.confidence(_knn(s, d)).select("vec_id", "percent", "confidence"),
          "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, list_cosine_distance(embedding::DOUBLE[], q) AS d FROM embeddings, q), y AS (SELECT vec_id, d, round(100 / (1 + d), 1) AS percent FROM x ORDER BY d, vec_id LIMIT 10) SELECT vec_id, percent, CASE WHEN percent >= 70 THEN 'high' WHEN percent >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM y")


def _centroids(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    """The mean vector of each of the ten labels: a vocabulary that SQL can make too."""
    each = _table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).orderBy("label").collect()
    return [[p["m"] for p in r["c"]] for r in rows]


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 50).alias("doc"), vectors.assign(_centroids(spark, sf_dir), F.col("embedding")).alias("cluster"))


def _weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.tf_idf(vectors.histogram(_assigned(spark, sf_dir), "doc"), "doc")


def _query_words(weighed: DataFrame) -> dict[int, float]:
    return {r["cluster"]: r["tf_idf"] for r in weighed.filter("doc = 7").collect()}


_WORDS = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1), a AS (SELECT vec_id, vec_id % 50 AS doc, arg_min(k, list_distance(v, c)) AS cluster FROM e, (SELECT label AS k, c FROM c ORDER BY 1) GROUP BY 1, 2),
h AS (SELECT doc, cluster, count(*) AS tf FROM a GROUP BY 1, 2), f AS (SELECT cluster, count(*) AS df FROM h GROUP BY 1), w AS (SELECT doc, cluster, tf, tf * ln((SELECT count(DISTINCT doc) FROM h) / df) AS x FROM h JOIN f USING (cluster))"""
_register("vec_assign", lambda s, d: _assigned(s, d).select("vec_id", "cluster"), _WORDS + " SELECT vec_id, cluster FROM a")
_register("vec_histogram", lambda s, d: vectors.histogram(_assigned(s, d), "doc"), _WORDS + " SELECT doc, cluster, tf FROM h")
_register("vec_tfidf", lambda s, d: _weighed(s, d).select("doc", "cluster", F.round("tf_idf", 6).alias("tf_idf")), _WORDS + " SELECT doc, cluster, round(x, 6) AS tf_idf FROM w")
_NEAR = """, l AS (SELECT doc, sqrt(sum(x * x)) AS l FROM w GROUP BY 1), q AS (SELECT cluster, x AS q FROM w WHERE doc = 7), dots AS (SELECT doc, sum(x * coalesce(q, 0)) AS dot FROM w LEFT JOIN q USING (cluster) GROUP BY 1),
r AS (SELECT doc, CASE WHEN l > 0 THEN 1 - dot / (l * (SELECT l FROM l WHERE doc = 7)) ELSE 1 END AS d FROM dots JOIN l USING (doc))"""


def _bovw(near):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        weighed = _weighed(spark, sf_dir)
        return near(weighed, "doc", _query_words(weighed), 5).select("doc", F.abs(F.round("_similarity_distance", 6)).alias("distance"))

    return build


_TOP5 = " SELECT doc, abs(round(d, 6)) AS distance FROM r {} ORDER BY round(d, 12), doc LIMIT 5"
_register("vec_bovw_knn", _bovw(vectors.nearest_words), _WORDS + _NEAR + _TOP5.format(""))
_register("vec_bovw_knn_pruned", _bovw(vectors.nearest_words_pruned), _WORDS + _NEAR + _TOP5.format("WHERE doc IN (SELECT doc FROM w JOIN (SELECT cluster FROM q WHERE q > 0 ORDER BY q DESC, cluster LIMIT 10) USING (cluster))"))
_register("vec_clusters", lambda s, d: vectors.ordered_clusters(_weighed(s, d), "doc", 7).select("cluster", F.round("tf_idf", 6).alias("tf_idf")), _WORDS + " SELECT cluster, round(x, 6) AS tf_idf FROM w WHERE doc = 7")
_register("vec_remove", lambda s, d: vectors.remove(_table(s, d, "embeddings").select("vec_id", "label"), "vec_id", [0, 5, 9]), "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (0, 5, 9)")


def _kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    words = vectors.train_vocabulary(e, "embedding", 10)
    return e.select("vec_id", vectors.assign(words, F.col("embedding")).alias("cluster"))


_register("vec_kmeans", _kmeans)


# media: pages as stored files
def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"), F.octet_length("html").cast("long").alias("length"))


_register("media_md5_dedup", lambda s, d: media.store(_pages(s, d)).groupBy("stored_name").agg(F.count(F.lit(1)).alias("files")), "SELECT md5(html) || '.html' AS stored_name, count(*) AS files FROM pages GROUP BY 1")


def _stored(spark: SparkSession, sf_dir: str) -> media.MediaStore:
    """All pages put twice; one name removed."""
    store = media.MediaStore(spark, f"{_scratch(spark)}/store")
    for _ in range(2):
        store.put(_pages(spark, sf_dir))
    store.remove(media.store(_pages(spark, sf_dir)).filter("path = '7.html'").first()["stored_name"])
    return store


_KEPT = "(SELECT md5(html) AS m, any_value(octet_length(encode(html))) AS n FROM pages WHERE md5(html) <> (SELECT md5(html) FROM pages WHERE page_id = 7) GROUP BY 1)"
_register("media_store_files", lambda s, d: _stored(s, d).read().select("stored_name", "length"), f"SELECT m || '.html' AS stored_name, n::BIGINT AS length FROM {_KEPT}")
_register("media_storage_stats", lambda s, d: _stored(s, d).stats(), f"SELECT count(*) AS files, sum(n)::BIGINT AS total_size FROM {_KEPT}")
_sql("media_key_range", "pages", "page_id", "SELECT page_id, url FROM pages WHERE page_id BETWEEN 10 AND 40", "SELECT page_id, url FROM pages WHERE page_id BETWEEN 10 AND 40")

"""The engine: statements in, DataFrames out."""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.catalog import Catalog, TableInfo
from quarry.operators import media, relational, spatial, text, vectors
from quarry.plans import ast
from quarry.plans.parser import parse
from quarry.sources import ingest
from quarry.types import MEDIA, SPATIAL, QuarryError, parse_type


@dataclass
class Result:
    """df for queries, message for statements; error instead of both where run() met one."""

    df: DataFrame | None = None
    message: str | None = None
    error: str | None = None


class Engine:
    #: Media files that one read is given.
    open_at_once = 100_000

    def __init__(self, spark: SparkSession, root: str, analyzer: text.Analyzer | None = None):
        self.spark, self.catalog = spark, Catalog(spark, root)
        self.analyzer = analyzer or text.Analyzer.english()
        self.views: dict[str, tuple[DataFrame, str]] = {}

    # the API's twins of statements
    def register(self, name: str, df: DataFrame, key: str) -> None:
        """A read-only table over any DataFrame."""
        self.views[name.lower()] = (df, key)

    def table(self, name: str) -> DataFrame:
        return self._table(name)[0]

    def _table(self, name: str) -> tuple[DataFrame, str]:
        if name.lower() in self.views:
            return self.views[name.lower()]
        info = self.catalog.info(name)
        return self.catalog.read(info), info.key

    def describe(self, name: str) -> DataFrame:
        return relational.describe(self.table(name))

    def stats(self, name: str) -> DataFrame:
        """One row of figures for the table (column null) and for each index: kind, and a map of figures."""
        df, key = self._table(name)
        indexes = {} if name.lower() in self.views else self.catalog.info(name).indexes
        parts = 0 if name.lower() in self.views else len(self.catalog.info(name).parts)
        figures = lambda **x: F.create_map(*[v for k, c in x.items() for v in (F.lit(k), c.cast("double"))])
        line = lambda d, column, kind, **x: d.select(F.lit(column).cast("string").alias("column"), F.lit(kind).alias("kind"), figures(**x).alias("figures"))
        out = line(df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("k")), None, "table", rows=F.col("n"), keys=F.col("k"), parts=F.lit(parts))
        for c, entry in indexes.items():
            if entry["kind"] == "spatial":
                each = spatial.extent(df, c)
                out = out.unionByName(line(each, c, "spatial", **{x: F.col(x) for x in ("geometries", "minx", "miny", "maxx", "maxy")}))
            elif entry["kind"] == "inverted":
                index = self._postings(entry)
                each = index.agg(F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"), F.count_distinct("doc").alias("documents"))
                out = out.unionByName(line(each, c, "inverted", terms=F.col("terms"), postings=F.col("postings"), documents=F.col("documents")))
            elif "base" in entry:
                each = self.spark.read.parquet(f"{entry['base']}/tfidf").agg(F.count_distinct("path").alias("d"), F.count_distinct("cluster").alias("w"))
                out = out.unionByName(line(each, c, "multimedia", documents=F.col("d"), words=F.col("w")))
        return out

    def text_search(self, name: str, column: str, query) -> DataFrame:
        """CONTAINS by API; a number looks its key up."""
        df, key = self._table(name)
        if isinstance(query, int):
            return df.filter(relational.compare(df, key, "=", query))
        return self._filtered(name, df, key, ast.Contains(column, query))

    def text_range(self, name: str, column: str, low: str, high: str) -> DataFrame:
        """A text index has no order: no rows."""
        return self._table(name)[0].limit(0)

    def append_file(self, name: str, path: str) -> Result:
        """The rows of a CSV or JSON file into a table that exists; a row that can't be one of it is an error."""
        info = self.catalog.info(name)
        rows = ingest.typed(ingest.strings(self.spark, path).select(*info.columns), {c: parse_type(t) for c, t in info.columns.items()})
        bad = ingest.rejects(rows, info.key).collect()  # a row for each reason
        if bad:
            raise QuarryError("; ".join(f"{r['rows']} rows: {r['_reason']}" for r in bad))
        return self._append(info, rows.drop("_reason"))

    def load_media(self, name: str, folder: str, extensions: tuple[str, ...] = ()) -> Result:
        """A row for each file below folder: the table's key counts on, its first media column has the path, others are null."""
        info = self.catalog.info(name)
        column = next((c for c, t in info.columns.items() if parse_type(t).name in MEDIA), None)
        if column is None:
            raise QuarryError(f"{name} has no column of {' or '.join(MEDIA)}")
        last = self.catalog.read(info).agg(F.max(info.key)).first()[0]
        paths = media.find_files(self.spark, folder, extensions).select("path").orderBy("path")
        numbered = paths.rdd.zipWithIndex().map(lambda r: (r[0]["path"], r[1])).toDF("path string, i long")
        first = 0 if last is None else last + 1
        given = {info.key: F.col("i") + first, column: F.col("path")}
        rows = numbered.select(*[given.get(c, F.lit(None)).cast(parse_type(t).spark).alias(c) for c, t in info.columns.items()])
        return self._append(info, rows)

    def tables(self) -> list[str]:
        return sorted({*self.catalog.names(), *self.views})

    def rebuild(self, name: str) -> None:
        """One sorted snapshot instead of many small parts."""
        info = self.catalog.info(name)
        self._replace(info, self.catalog.read(info))

    def insert(self, name: str, rows: DataFrame) -> Result:
        """The rows of a DataFrame, by column name, in one write; a key that is null or exists is an error."""
        info = self.catalog.info(name)
        return self._append(info, rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in info.schema()]))

    def update(self, name: str, key_value, changes: dict) -> None:
        info = self.catalog.info(name)
        if info.key in changes:
            raise QuarryError("a key can't be changed")
        self._replace(info, relational.update(self.catalog.read(info), info.key, key_value, changes))

    # writes keep the indexes
    def _replace(self, info: TableInfo, rows: DataFrame) -> None:
        """A new snapshot with its indexes made anew."""
        self.catalog.replace(info, rows)
        for column in [c for c, e in info.indexes.items() if e["kind"] in ("inverted", "multimedia")]:
            info.indexes[column] |= self._indexed(info, column, info.indexes[column])
        self.catalog.save(info)

    def _append(self, info: TableInfo, rows: DataFrame) -> Result:
        now = self.catalog.read(info)
        relational.insert(now.join(rows.select(info.key), info.key, "left_semi"), rows, info.key)
        part = self.catalog.write_part(info, rows)
        new = self.spark.read.schema(info.schema()).parquet(part)
        info.parts.append(part)
        for c, entry in info.indexes.items():
            if entry["kind"] == "inverted":
                entry["postings"].append(self._write_postings(info, c, new))
                entry["documents"] += text.filled(new, c)
            elif entry["kind"] == "multimedia":
                entry |= self._indexed(info, c, entry)
        self.catalog.save(info)
        n = new.count()
        return Result(message=f"{n} row{'s' * (n != 1)} inserted")

    def _write_postings(self, info: TableInfo, column: str, rows: DataFrame) -> str:
        path = f"{self.catalog.root}/{info.name.lower()}/postings-{uuid.uuid4().hex}"
        text.write_postings(text.postings(rows, info.key, column, self.analyzer), path)
        return path

    def _postings(self, entry: dict) -> DataFrame:
        return self.spark.read.parquet(*entry["postings"])

    def _indexed(self, info: TableInfo, column: str, entry: dict) -> dict:
        """What an index of the table's present rows holds."""
        if entry["kind"] == "inverted":
            rows = self.catalog.read(info)
            return {"postings": [self._write_postings(info, column, rows)], "documents": text.filled(rows, column)}
        return self._train(info, column, entry)

    def execute(self, sql: str) -> Result:
        """Raises QuarryError for what can't be parsed or resolved."""
        statement = parse(sql)
        return getattr(self, f"_{type(statement).__name__.lower()}")(statement)

    def run(self, sql: str) -> Result:
        """execute(), with errors in the result."""
        try:
            return self.execute(sql)
        except Exception as e:
            return Result(error=str(e))

    # statements
    def _createtable(self, s: ast.CreateTable) -> Result:
        if self.catalog.exists(s.table):
            raise QuarryError(f"table exists: {s.table}")
        indexes = {c.name: {"kind": "spatial"} for c in s.columns if c.type.name in SPATIAL}
        self.catalog.save(TableInfo(s.table, {c.name: str(c.type) for c in s.columns}, s.key, s.index, [], indexes))
        return Result(message=f"table {s.table} created")

    def _loadtable(self, s: ast.LoadTable) -> Result:
        if self.catalog.exists(s.table):
            raise QuarryError(f"table exists: {s.table}")
        rows, types = ingest.load(self.spark, s.path)
        if s.key not in types:
            raise QuarryError(f"no such column: {s.key}")
        info = TableInfo(s.table, {c: str(t) for c, t in types.items()}, s.key, s.index)
        info.indexes = {c: {"kind": "spatial"} for c, t in types.items() if t.name in SPATIAL}
        bad = ingest.rejects(rows, s.key).collect()  # a row for each reason
        good = rows.filter(F.col("_reason").isNull() & F.col(s.key).isNotNull()).drop("_reason")
        self.catalog.replace(info, good.dropDuplicates([s.key]) if any(r["_reason"] == "the key comes again" for r in bad) else good)
        return Result(message=f"table {s.table} loaded" + "".join(f"; {r['rows']} rows left out: {r['_reason']}" for r in sorted(bad)))

    def _droptable(self, s: ast.DropTable) -> Result:
        if self.views.pop(s.table.lower(), None) is None:
            self.catalog.drop(s.table)
        return Result(message=f"table {s.table} dropped")

    def _createindex(self, s: ast.CreateIndex) -> Result:
        info = self.catalog.info(s.table)
        if s.column not in info.columns:
            raise QuarryError(f"no such column: {s.column}")
        kind = parse_type(info.columns[s.column]).name
        wanted = {"inverted": ("VARCHAR",), "spatial": SPATIAL, "multimedia": MEDIA}[s.kind]
        if kind not in wanted:
            raise QuarryError(f"a {s.kind} index needs a column of {' or '.join(wanted)}, not {kind}")
        if info.indexes.get(s.column, {}).get("kind") == s.kind and s.kind != "spatial":
            raise QuarryError(f"{s.column} has a {s.kind} index")
        entry = {"kind": s.kind, "name": s.name, **s.options}
        if s.kind == "multimedia":
            media.extractor(s.options["media"], s.options["method"])  # raises for unknown media
        if s.kind in ("inverted", "multimedia"):
            entry |= self._indexed(info, s.column, entry)
        info.indexes[s.column] = entry
        self.catalog.save(info)
        return Result(message=f"index {s.name} created")

    def _insert(self, s: ast.Insert) -> Result:
        info = self.catalog.info(s.table)
        types = {c: parse_type(t) for c, t in info.columns.items()}
        for values in s.rows:
            if len(values) != len(types):
                raise QuarryError(f"{len(types)} values are needed, not {len(values)}")
        cells = [tuple(None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in values) for values in s.rows]
        given = self.spark.createDataFrame(cells, ", ".join(f"`{c}` string" for c in types))
        made = ingest.typed(given, types).collect()  # the statement's own rows
        for r, values in zip(made, s.rows, strict=True):
            if r["_reason"]:
                raise QuarryError(f"{r['_reason']}: {values!r}")
        return self._append(info, self.spark.createDataFrame([tuple(r)[:-1] for r in made], info.schema()))

    def _delete(self, s: ast.Delete) -> Result:
        info = self.catalog.info(s.table)
        if s.column != info.key:
            raise QuarryError(f"rows are deleted by {info.key} only")
        now = self.catalog.read(info)
        n = now.filter(relational.compare(now, info.key, "=", s.value)).count()
        if n:
            self._replace(info, relational.delete(now, info.key, s.value))
        return Result(message=f"{n} row{'s' * (n != 1)} deleted")

    def _count(self, s: ast.Count) -> Result:
        return Result(relational.count(self.table(s.table)))

    def _select(self, s: ast.Select) -> Result:
        df, key = self._table(s.table)
        names = list(df.columns)
        out = self._filtered(s.table, df, key, s.where) if s.where is not None else df
        if s.count:
            return Result(relational.count(out))
        if s.top is not None:
            out = relational.top(out, key, s.top)
        if s.order:
            out = relational.ordered(out, list(s.order), key, s.limit, s.offset)
        elif s.limit is not None or s.offset:
            ranked = isinstance(s.where, (ast.RankedBy, ast.Nearest, ast.SimilarTo))  # these have an order
            out = relational.ordered(out, [(key, False)], key, s.limit, s.offset) if s.offset and not ranked else out.offset(s.offset) if s.offset else out
            out = out if s.limit is None else out.limit(s.limit)
        if s.columns is not None:
            out = relational.project(out, list(s.columns))
        elif set(names) - set(out.columns):
            out = out.select(*names)
        return Result(out)

    # predicates
    def _filtered(self, table: str, df: DataFrame, key: str, p) -> DataFrame:
        if isinstance(p, ast.Contains):
            relational.column(df, p.column)
            out = self._contains(table, df, key, p)
            return out.orderBy(key).limit(p.limit) if p.limit is not None else out
        if isinstance(p, ast.RankedBy):
            relational.column(df, p.column)
            entry = self._text_index(table, p.column)
            if entry is None:
                return text.ranked(df, key, p.column, p.query, p.limit, self.analyzer)
            hits = text.index_ranked(self._postings(entry), entry["documents"], p.query, p.limit, self.analyzer)
            return df.join(hits.withColumnRenamed("doc", "_doc"), df[key] == F.col("_doc")).drop("_doc").orderBy(F.desc("_score"), key)
        if isinstance(p, ast.Phrase):
            relational.column(df, p.column)
            return text.phrase(df, p.column, p.query, self.analyzer)
        if isinstance(p, ast.Within):
            relational.column(df, p.column)
            return spatial.within(df, p.column, p.point, p.radius)
        if isinstance(p, ast.Intersects):
            relational.column(df, p.column)
            return spatial.intersects(df, p.column, p.box)
        if isinstance(p, ast.Nearest):
            relational.column(df, p.column)
            return spatial.nearest(df, key, p.column, p.point, p.limit)
        if isinstance(p, ast.SimilarTo):
            return self._similar(table, df, key, p)
        return df.filter(self._condition(df, p))

    def _text_index(self, table: str, column: str) -> dict | None:
        entry = {} if table.lower() in self.views else self.catalog.info(table).indexes.get(column, {})
        return entry if entry.get("kind") == "inverted" else None

    def _contains(self, table: str, df: DataFrame, key: str, p: ast.Contains) -> DataFrame:
        entry = self._text_index(table, p.column)
        if entry is None:
            return text.contains(df, key, p.column, p.query, self.analyzer)
        index, keys = self._postings(entry), df.select(F.col(key).alias("doc"))
        if text.is_boolean(p.query) or len(self.analyzer.terms(p.query)) == 1:
            hits = text.index_boolean(index, keys, p.query, self.analyzer)
        else:
            hits = text.index_ranked(index, entry["documents"], p.query, text.CAP, self.analyzer).select("doc")
        return df.join(hits.withColumnRenamed("doc", "_doc"), df[key] == F.col("_doc"), "left_semi")

    def _condition(self, df: DataFrame, p) -> Column:
        if isinstance(p, ast.IsIn):
            return relational.is_in(df, p.column, list(p.values))
        if isinstance(p, ast.Like):
            return relational.like(df, p.column, p.pattern)
        if isinstance(p, ast.IsNull):
            return relational.column(df, p.column).isNull()
        if isinstance(p, ast.Compare):
            return relational.compare(df, p.column, p.op, p.value)
        if isinstance(p, ast.Between):
            return relational.between(df, p.column, p.low, p.high)
        if isinstance(p, ast.And):
            return self._condition(df, p.left) & self._condition(df, p.right)
        if isinstance(p, ast.Or):
            return self._condition(df, p.left) | self._condition(df, p.right)
        if isinstance(p, ast.Not):
            return ~self._condition(df, p.inner)
        raise QuarryError(f"{type(p).__name__} can't be combined with other conditions")

    # media
    def _train(self, info: TableInfo, column: str, options: dict) -> dict:
        """Descriptors of the column's files, a vocabulary (of the training folder, or of the column) and the documents' tf-idf, as Parquet."""
        base = f"{self.catalog.root}/{info.name.lower()}/media-{uuid.uuid4().hex}"
        files = self.catalog.read(info).select(F.col(column).alias("path")).filter("path IS NOT NULL").distinct()
        own, names = None, files.toLocalIterator()
        while some := [r["path"] for r in itertools.islice(names, self.open_at_once)]:  # paths to open; descriptors of all go to Parquet
            media.descriptors(self._open(some), options["media"], options["method"]).write.mode("append").parquet(f"{base}/descriptors")
            own = self.spark.read.parquet(f"{base}/descriptors")
        source = media.descriptors(media.find_files(self.spark, options["train"]), options["media"], options["method"]) if "train" in options else own
        if source is None:
            return {}
        words = vectors.train_vocabulary(source.filter("descriptor IS NOT NULL"), "descriptor")
        self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(words)], "cluster int, centroid array<double>").coalesce(1).write.parquet(f"{base}/words")
        if own is not None:
            good = own.filter("descriptor IS NOT NULL")
            hist = vectors.histogram(good.select("path", vectors.assign(words, F.col("descriptor")).alias("cluster")), "path")
            vectors.tf_idf(hist, "path").write.parquet(f"{base}/tfidf")
        return {"base": base}

    def _open(self, paths: list[str]) -> DataFrame:
        files = self.spark.read.format("binaryFile").load(paths)
        asked = self.spark.createDataFrame([(p, p.split("://")[-1].removeprefix("file:")) for p in paths], "asked string, plain string")
        plain = F.regexp_replace("path", "^file:/*", "/")
        return files.join(asked, plain == F.col("plain")).select(F.col("asked").alias("path"), "content", "length")

    def _similar(self, table: str, df: DataFrame, key: str, p: ast.SimilarTo) -> DataFrame:
        entry = self.catalog.info(table).indexes.get(p.column, {})
        if entry.get("kind") != "multimedia" or "base" not in entry:
            raise QuarryError(f"{p.column} has no trained multimedia index")
        rows = self.spark.read.parquet(f"{entry['base']}/words").orderBy("cluster").collect()  # at most 500 centroids
        words = [r["centroid"] for r in rows]
        weighed = self.spark.read.parquet(f"{entry['base']}/tfidf")
        asked = media.descriptors(self._open([p.path]), entry["media"], entry["method"])
        n = weighed.select("path").distinct().count()
        hist = vectors.histogram(asked.filter("descriptor IS NOT NULL").select("path", vectors.assign(words, F.col("descriptor")).alias("cluster")), "path")
        known = weighed.groupBy("cluster").agg(F.max("df").alias("df"))
        query = {r["cluster"]: r["q"] for r in hist.join(known, "cluster").select("cluster", (F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))).alias("q")).collect()}
        hits = vectors.nearest_words(weighed, "path", query, p.limit)
        return df.join(hits.withColumnRenamed("path", "_path"), df[p.column] == F.col("_path")).drop("_path").orderBy("_similarity_distance", key).limit(p.limit)

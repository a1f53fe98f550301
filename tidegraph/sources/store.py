"""A versioned Parquet store: each commit writes new folders of the tables it changes, then one numbered file that names them.

The highest number is the current version. Its file appears by a rename that fails if the number is taken, so a commit
that dies leaves the version before it, and of two writers of one version the second fails and loses nothing. Tables are partitioned by
group_id, so group filters prune partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import EDGES, ENDS, NODES, TABLES


class NotFound(LookupError):
    """No row has the uuid."""


class Conflict(RuntimeError):
    """Another writer has committed since this one read."""


def last_of(batch: DataFrame, key: str = "uuid", order: str | None = None) -> DataFrame:
    """The last row of each key inside a batch by the order column (ties, or without one: by a hash of the row)."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in batch.columns])))
    w = Window.partitionBy(key).orderBy(*([F.desc(order)] if order else []), row)
    return batch.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merge(existing: DataFrame, batch: DataFrame, key: str = "uuid", order: str | None = None) -> DataFrame:
    """Upsert: rows of the batch replace rows of the same key, all columns."""
    new = last_of(batch, key, order)
    return existing.join(new.select(key), key, "left_anti").unionByName(new.drop(order) if order else new, allowMissingColumns=True)


def linked(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose endpoints both exist."""
    return edges.join(sources.select(F.col("uuid").alias("source_node_uuid")), "source_node_uuid", "left_semi").join(targets.select(F.col("uuid").alias("target_node_uuid")), "target_node_uuid", "left_semi").select(*edges.columns)


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the deleted nodes (uuid)."""
    out = edges
    for end in ("source_node_uuid", "target_node_uuid"):
        out = out.join(gone.select(F.col("uuid").alias(end)), end, "left_anti")
    return out.select(*edges.columns)


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def number(self) -> int:
        """The current version, 0 before the first commit."""
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_versions")
        return max((int(f.getPath().getName()) for f in (fs.listStatus(at) if fs.exists(at) else []) if f.getPath().getName().isdigit()), default=0)

    def version(self, number: int | None = None) -> dict[str, str]:
        """Table -> folder of a version, the current one if none is named."""
        number = self.number() if number is None else number
        if not number:
            return {}
        return {r.table: r.folder for r in self.spark.read.schema("table string, folder string").json(f"{self.root}/_versions/{number:010d}").collect()}

    def read(self, table: str, number: int | None = None) -> DataFrame:
        folder = self.version(number).get(table)
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], TABLES[table])

    def commit(self, tables: Mapping[str, DataFrame], after: int | None = None) -> int:
        """Writes the new tables beside the old ones, then the next number's file; fails if the version is no longer `after`."""
        after = self.number() if after is None else after
        now, stamp = self.version(after), uuid.uuid4().hex
        for name, df in tables.items():
            now[name] = f"{name}/{stamp}"
            df.select(*[c.split()[0] for c in _columns(name)]).write.partitionBy("group_id").parquet(f"{self.root}/{now[name]}")
        self._flip(now, after + 1, stamp)
        return after + 1

    def _flip(self, now: dict[str, str], number: int, stamp: str) -> None:
        import json

        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        new, target = path(f"{self.root}/_next-{stamp}"), path(f"{self.root}/_versions/{number:010d}")
        out = fs.create(new, False)
        out.write("".join(json.dumps({"table": t, "folder": f}) + "\n" for t, f in now.items()).encode())
        out.close()
        fs.mkdirs(target.getParent())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(target), none)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {number} is another writer's") from e
            raise

    def vacuum(self, keep: int = 2) -> None:
        """Deletes folders that none of the last `keep` versions names; readers of older ones fail from then on."""
        jvm, fs = self._fs()
        path, last = jvm.org.apache.hadoop.fs.Path, self.number()
        used = {f for n in range(max(1, last - keep + 1), last + 1) for f in self.version(n).values()}
        for t in TABLES:
            if fs.exists(path(f"{self.root}/{t}")):
                for f in fs.listStatus(path(f"{self.root}/{t}")):
                    if f"{t}/{f.getPath().getName()}" not in used:
                        fs.delete(f.getPath(), True)
        for n in range(1, last - keep + 1):
            fs.delete(path(f"{self.root}/_versions/{n:010d}"), True)

    def count(self) -> DataFrame:
        """(table, n) of all node tables."""
        return reduce(DataFrame.unionByName, [self.read(t).agg(F.lit(t).alias("table"), F.count("*").alias("n")) for t in NODES])

    def log(self, kind: str, rows: DataFrame) -> None:
        """Appends calls or pipeline steps to a log beside the tables; logs have no versions."""
        rows.write.mode("append").parquet(f"{self.root}/_log/{kind}")

    def logged(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_log/{kind}")

    def upsert(self, batch: Mapping[str, DataFrame], order: str | None = None) -> int:
        """One transaction: nodes first, then edges; edges without both endpoints are left out.

        Of a batch's rows of one key the last by the column `order` stays, if the batch has it.
        """
        at = self.number()
        last = {t: self._full(t, last_of(d, order=order if order in d.columns else None)) for t, d in batch.items()}
        old = lambda t: self.read(t, at)
        new = {t: merge(old(t), last[t]) for t in NODES if t in last}
        have = lambda t: new.get(t, old(t)).select("uuid")
        for t in EDGES:
            if t in last:
                sources, targets = ENDS[t]
                union = lambda names: reduce(DataFrame.unionByName, map(have, names))
                new[t] = merge(old(t), linked(last[t], union(sources), union(targets)))
        return self.commit(new, at)

    def remove_communities(self) -> int:
        """Deletes all communities and their links."""
        return self.commit({t: self.read(t).limit(0) for t in ("community", "has_member")})

    def _full(self, table: str, df: DataFrame) -> DataFrame:
        """df with every column of the table, missing ones null, and the table's types."""
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def delete_nodes(self, table: str, gone: DataFrame) -> None:
        """Deletes nodes by uuid and every edge that touches them."""
        out = {table: self.read(table).join(gone.select("uuid"), "uuid", "left_anti")}
        for t in EDGES:
            if any(table in side for side in ENDS[t]):
                out[t] = without_nodes(self.read(t), gone)
        self.commit(out)

    def delete_edges(self, table: str, gone: DataFrame) -> None:
        self.commit({table: self.read(table).join(gone.select("uuid"), "uuid", "left_anti")})

    def clear(self, groups: list[str] | None = None) -> None:
        """Deletes the groups' rows of all tables; all groups if none are named."""
        self.commit({t: self.read(t).filter(~F.col("group_id").isin(groups)) if groups else self.read(t).limit(0) for t in TABLES})

    def by_uuid(self, table: str, key: str) -> DataFrame:
        df = self.read(table).filter(F.col("uuid") == key)
        if not df.limit(1).count():
            raise NotFound(f"{table}: {key}")
        return df


def _columns(table: str) -> list[str]:
    out, depth, at = [], 0, 0
    ddl = TABLES[table]
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]

"""Tables with versions in a folder: insert-if-absent, upserts and imports that happen wholly or not at all.

A version is a parquet folder. Numbered pointer files name the versions; the one with the largest number counts, and it
appears by one rename after its version is whole, so a crash at any point leaves the former or the new version and never
none. Two writers that start from the same version can't both win: the second finds its number taken. An import of
several tables has one pointer for all of them. Partitions by run are only added to.

Where several rows of a batch share a key, the last in the given `order` counts; without an order the greatest row by all
its columns does, so a result never depends on how rows lie.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTER = "current-"


def identifier(name: str) -> str:
    """`name` if it is a plain identifier, else an error."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def last_rows(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row per key: the last in `order` (columns or expressions, ascending), ties by the greatest row."""
    rest = [F.col(c) for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) if isinstance(c, str) else c.desc_nulls_last() for c in [*(order or []), *rest]])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def absent(new: DataFrame, old: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows whose key isn't there yet, one per key."""
    return last_rows(new, keys, order).join(old.select(*keys), keys, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Old rows with `columns` (all but the keys) as the new row of the same key has them, null included, and the new keys.

    Columns that only one side has are kept, null for the other's rows; those that `new` lacks are never overwritten.
    """
    both = [c for c in old.columns if c not in keys] + [c for c in new.columns if c not in keys and c not in old.columns]
    changed = set(columns if columns is not None else both)
    a = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in old.columns if c not in keys], F.lit(True).alias("__old"))
    b = last_rows(new, keys, order).select(*keys, *[F.col(c).alias(f"__n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("__new"))
    j = a.join(b, keys, "full")

    def pick(c: str) -> Column:
        o, n = (F.col(f"__o_{c}") if c in old.columns else None), (F.col(f"__n_{c}") if c in new.columns else None)
        if o is None or n is None:
            return (n if o is None else o).alias(c)
        take = F.col("__new") if c in changed else F.col("__old").isNull()
        return F.when(take, n).otherwise(o).alias(c)

    return j.select(*keys, *[pick(c) for c in both])


class Folder:
    """Numbered pointer files of a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}" if x else self.path)
        self._fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._p(""))] if self._fs.exists(self._p("")) else []

    def number(self) -> int:
        return max([0, *(int(n[len(POINTER) :]) for n in self.names() if re.fullmatch(re.escape(POINTER) + r"\d+", n))])

    def read_text(self, name: str) -> str:
        s = self._fs.open(self._p(name))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(s)).decode()
        finally:
            s.close()

    def write_text(self, name: str, text: str) -> None:
        out = self._fs.create(self._p(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def point(self, text: str, after: int) -> None:
        """Makes `text` the current content, if `after` still is the last number: a file is written aside, then renamed."""
        aside, name = f"next-{uuid.uuid4().hex}", f"{POINTER}{after + 1:012d}"
        self.write_text(aside, text)
        if self._fs.exists(self._p(name)) or not self._fs.rename(self._p(aside), self._p(name)):
            self._fs.delete(self._p(aside), False)
            raise RuntimeError(f"{self.path}: another writer was faster")

    def current(self) -> str | None:
        n = self.number()
        return self.read_text(f"{POINTER}{n:012d}").strip() if n else None

    def delete(self, name: str) -> None:
        self._fs.delete(self._p(name), True)


class Versioned:
    """A table below `path`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._folder = spark, path.rstrip("/"), Folder(spark, path)

    def version(self) -> str | None:
        return self._folder.current()

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/{v}") if v else None

    def replace(self, df: DataFrame) -> str:
        """Writes `df` as the new version, then makes it the current one."""
        after = self._folder.number()
        v = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{v}")
        self._folder.point(v, after)
        return v

    def insert_absent(self, df: DataFrame, keys: list[str], order: list[Column] | None = None) -> None:
        old = self.read()
        self.replace(last_rows(df, keys, order) if old is None else old.unionByName(absent(df, old, keys, order), allowMissingColumns=True))

    def upsert(self, df: DataFrame, keys: list[str], columns: list[str] | None = None, order: list[Column] | None = None) -> None:
        old = self.read()
        self.replace(last_rows(df, keys, order) if old is None else upserted(old, df, keys, columns, order))

    def drop_old(self) -> None:
        """Removes all versions and pointers but the current ones."""
        n, keep = self._folder.number(), self.version()
        for name in self._folder.names():
            if name.startswith("v-") and name != keep or name.startswith(POINTER) and name != f"{POINTER}{n:012d}":
                self._folder.delete(name)


class Database:
    """Several tables below `path` whose versions change together."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._folder = spark, path.rstrip("/"), Folder(spark, path)

    def versions(self) -> dict[str, str]:
        return json.loads(self._folder.current() or "{}")

    def read(self, name: str) -> DataFrame | None:
        v = self.versions().get(identifier(name))
        return self.spark.read.parquet(f"{self.path}/{name}/{v}") if v else None

    def require(self, *names: str) -> None:
        """An error that names the tables that aren't there."""
        if missing := sorted(set(names) - set(self.versions())):
            raise LookupError(f"{self.path} has no {', '.join(missing)}")

    def run(self, steps: dict[str, Callable[[DataFrame | None], DataFrame]]) -> dict[str, str]:
        """Every step makes a table's next rows from its present ones; all of them count from the same instant, or, if any
        step fails, none."""
        after, v = self._folder.number(), self.versions()
        new = {}
        try:
            for name, step in steps.items():
                new[name] = f"v-{uuid.uuid4().hex}"
                step(self.read(identifier(name))).write.parquet(f"{self.path}/{name}/{new[name]}")
            self._folder.point(json.dumps(v | new, sort_keys=True), after)
        except BaseException:
            for name, x in new.items():
                self._folder.delete(f"{name}/{x}")
            raise
        return new


def inserting(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> Callable[[DataFrame | None], DataFrame]:
    return lambda old: last_rows(df, keys, order) if old is None else old.unionByName(absent(df, old, keys, order), allowMissingColumns=True)


def upserting(df: DataFrame, keys: list[str], columns: list[str] | None = None, order: list[Column] | None = None) -> Callable[[DataFrame | None], DataFrame]:
    return lambda old: last_rows(df, keys, order) if old is None else upserted(old, df, keys, columns, order)


#: What an import does to each table: its key, and the columns that a row that is there already takes over (None: none).
IMPORT = {
    "tournaments": (["tournament_id"], ["team_count", "match_count", "stage_count", "is_ranked", "is_finalized", "tags"]),
    "stages": (["stage_id"], None),
    "groups": (["group_id"], None),
    "rounds": (["round_id"], None),
    "teams": (["team_id"], None),
    "players": (["player_id"], ["display_name", "discord_id", "country"]),
    "rosters": (["tournament_id", "team_id", "player_id"], None),
    "matches": (["match_id"], None),
    "appearances": (["tournament_id", "match_id", "player_id"], None),
}


def import_all(db: Database, tables: dict[str, DataFrame], order: dict[str, list[Column]] | None = None) -> dict[str, str]:
    """All tables of a parse in one step: rows that are new are added, and of known ones only the listed columns change."""
    steps = {}
    for name, (keys, columns) in IMPORT.items():
        if name not in tables:
            continue
        df, by = tables[name].dropna(subset=keys), (order or {}).get(name)
        steps[name] = inserting(df, keys, by) if columns is None else upserting(df, keys, [c for c in columns if c in df.columns], by)
    return db.run(steps)


def repull(db: Database, tables: dict[str, DataFrame], tournaments: list[int]) -> dict[str, str]:
    """Everything of the given tournaments deleted and imported anew; if anything fails all is as it was."""
    def again(name: str, keys: list[str]) -> Callable[[DataFrame | None], DataFrame]:
        fresh = last_rows(tables[name].dropna(subset=keys), keys)

        def step(old: DataFrame | None) -> DataFrame:
            if old is None:
                return fresh
            kept = old.where(~F.col("tournament_id").isin(tournaments) | F.col("tournament_id").isNull()) if "tournament_id" in old.columns else old
            return kept.unionByName(absent(fresh, kept, keys), allowMissingColumns=True)

        return step

    return db.run({n: again(n, keys) for n, (keys, _) in IMPORT.items() if n in tables})


def add_run(df: DataFrame, path: str, run: dict[str, object]) -> bool:
    """Adds a run's rows as a partition keyed by `run`; a run that is there already is left as it is (False)."""
    folder = Folder(df.sparkSession, path.rstrip("/") + "/" + "/".join(f"{identifier(k)}={v}" for k, v in run.items()))
    if "_SUCCESS" in folder.names():
        return False
    df.drop(*run).write.mode("overwrite").parquet(folder.path)
    return True


def manifest(tables: dict[str, DataFrame], **more: object) -> str:
    """Row counts and columns of a run's tables as JSON."""
    return json.dumps({"tables": {n: {"rows": df.count(), "columns": df.columns} for n, df in tables.items()}} | more, sort_keys=True, default=str)


def bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame], **more: object) -> dict:
    """Parquet files and `manifest.json` of a run below `path`, each table without columns left out; the manifest comes last."""
    kept = {n: df for n, df in tables.items() if df.columns}
    for n, df in kept.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{identifier(n)}")
    text = manifest({n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in kept}, **more)
    Folder(spark, path).write_text("manifest.json", text)
    return json.loads(text)


def save_engine(spark: SparkSession, path: str, config: dict, scores: DataFrame, influence: DataFrame) -> None:
    """An engine's state: its settings, the rated players and the tournaments' influence."""
    bundle(spark, path, {"scores": scores, "influence": influence}, config=config)


def load_engine(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    config = json.loads(Folder(spark, path).read_text("manifest.json"))["config"]
    return config, spark.read.parquet(f"{path.rstrip('/')}/scores"), spark.read.parquet(f"{path.rstrip('/')}/influence")

"""The event log with its audit entries and certificates, and its exchange form.

A commit is one small file that names the folders of all tables it adds to, the log's last
number and the chain's head. It is published only if no other writer took its number, so
a chain cannot fork, log and audit never part, and a job that dies leaves nothing half
visible. After COMPACT_AFTER commits their folders are written as one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from . import files

JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
COMPACT_AFTER = 64
TABLES = {"log": S.LOG, "audit": S.AUDIT, "certificate": S.CERTIFICATE}


@dataclass(frozen=True)
class State:
    """The last commit: its number, the commit that its folders are listed from, the log's last number, the chain's head."""

    number: int = 0
    since: int = 1
    last_seq: int = 0
    head: str | None = None


class Log:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _commit(self, number: int) -> dict:
        return json.loads(files.read(self.spark, f"{self.path}/commits/{number:012d}.json"))

    def state(self) -> State:
        found = files.names(self.spark, f"{self.path}/commits")
        if not found:
            return State()
        c = self._commit(int(found[-1].split(".")[0]))
        return State(c["number"], c["since"], c["last_seq"], c["head"])

    def folders(self, table: str, state: State) -> list[str]:
        commits = [self._commit(n) for n in range(state.since, state.number + 1)]
        return [f"{self.path}/data/{f}" for c in commits for f in c["tables"].get(table, [])]

    def table(self, name: str, state: State | None = None) -> DataFrame:
        """All rows up to a commit, in one scan; an absent log is empty."""
        found = self.folders(name, state or self.state())
        return self.spark.read.schema(TABLES[name]).parquet(*found) if found else self.spark.createDataFrame([], TABLES[name])

    def write(self, name: str, rows: DataFrame) -> str:
        """Rows in a folder that no commit names yet; returns the folder."""
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.select(*[f.name for f in TABLES[name]]).write.parquet(f"{self.path}/data/{folder}")
        return folder

    def read(self, name: str, folder: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/data/{folder}")

    def publish(self, before: State, tables: dict[str, list[str]], last_seq: int, head: str | None, since: int | None = None) -> bool:
        """Add the folders as the commit after `before`; if another writer was quicker they are deleted, and False is returned."""
        n = before.number + 1
        commit = {"number": n, "since": since or before.since, "last_seq": last_seq, "head": head, "tables": tables}
        if files.publish(self.spark, f"{self.path}/commits/{n:012d}.json", json.dumps(commit)):
            return True
        for folder in (f for xs in tables.values() for f in xs):
            files.delete(self.spark, f"{self.path}/data/{folder}")
        return False

    def compact(self, least: int = 2) -> bool:
        """Write the folders of all commits as one for each table, if there are so many; old ones stay for readers that began before."""
        state = self.state()
        if state.number - state.since + 1 < least:
            return False
        tables = {name: [self.write(name, self.table(name, state))] for name in TABLES if self.folders(name, state)}
        return self.publish(state, tables, state.last_seq, state.head, since=state.number + 1)

    def truncate(self) -> None:
        """Forget everything."""
        files.delete(self.spark, self.path)

    def __len__(self) -> int:
        return self.state().last_seq


def complete(rows: DataFrame) -> DataFrame:
    """Rows with all columns of the log, absent ones null."""
    have = {c.lower() for c in rows.columns}
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.LOG])


def encode_json(log: DataFrame) -> DataFrame:
    """(seq, payload): each row as JSON, times exact to the microsecond."""
    return log.select("seq", F.to_json(F.struct(*[c for c in log.columns if c != "seq"]), {"timestampFormat": JSON_TIME}).alias("payload"))


def decode_json(rows: DataFrame, schema=S.LOG) -> DataFrame:
    fields = [f for f in schema if f.name != "seq"]
    parsed = F.from_json("payload", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields), {"timestampFormat": JSON_TIME})
    return rows.select("seq", parsed.alias("x")).select("seq", "x.*")


def union_ordered(episodes: DataFrame, fact_events: DataFrame) -> DataFrame:
    """Two event tables as one log; a fact's scope is that of its source episode."""
    scope = episodes.select(F.col("episode_id").alias("__e"), "subject_id")
    facts = fact_events.drop("subject_id").join(scope, F.col("episode_id") == F.col("__e"), "left").drop("__e")
    return episodes.unionByName(facts, allowMissingColumns=True)


def create_tables(spark: SparkSession, database: str) -> None:
    """Create the tables where they are absent."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in (("event_log", S.LOG), ("audit_entry", S.AUDIT), ("certificate", S.CERTIFICATE), ("keyring", S.KEYRING), ("edge", S.EDGE), ("entity", S.ENTITY)):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def redacted(dsn):
    """A connection string without its password."""
    return F.regexp_replace(dsn, r"(://[^:/@]+:)[^@]+@", "$1***@")

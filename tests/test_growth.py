"""What must not grow with the input: files for each subject, rows in one task, calls for each key."""

import glob
import hashlib
import json

from pyspark.sql import functions as F


def _count(monkeypatch, module, name):
    said, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (said.append(a), real(*a, **k))[1])
    return said


def test_keys_of_many_subjects_are_few_files(spark, tmp_path, monkeypatch):
    from chronofact import schemas as S
    from chronofact.engine import Engine
    from chronofact.sources import files

    rows = spark.range(400).select(
        F.lit(S.ASSERTED).alias("op"), F.concat(F.lit("f"), "id").alias("fact_id"), F.concat(F.lit("u"), F.col("id") % 200).alias("subject_id"), F.lit("x").alias("object"),
        F.current_timestamp().alias("recorded_at"), F.col("id").alias("__order"),
    )
    m = Engine(spark, str(tmp_path), root_key=b"k" * 32)
    said = _count(monkeypatch, files, "publish")
    m.append(rows)
    assert len(said) <= 20  # 16 parts of the keyring and the commit
    assert m.keyring.frame().select("subject_id").distinct().count() == m.keyring.frame().count() == 200
    assert m.log().count() == 400 and m.log().where("object = 'x'").count() == 400
    m.append(rows.withColumn("subject_id", F.concat(F.lit("u"), F.col("__order") % 210)).withColumn("fact_id", F.concat("fact_id", F.lit("b"))))
    assert m.keyring.frame().count() == 210 and m.log().count() == 800  # known subjects keep their keys
    assert m.forget("u7")["facts_deleted"] == 4
    raw = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/keyring/**/*.json", recursive=True))
    assert '"u8"' in raw and '"u7"' not in raw
    assert m.log().where("op = 'asserted'").count() == 796 and m.verify_audit(deep=True).ok


def test_writers_agree_on_keys(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from chronofact.sources.keyring import FileKeyring

    path, names = str(tmp_path / "ring"), [f"u{i}" for i in range(24)]
    old = FileKeyring(spark, path, b"k" * 32)
    (tmp_path / "ring").mkdir()
    (tmp_path / "ring" / f"{hashlib.sha256(b'u3').hexdigest()}.json").write_text(json.dumps({"subject_id": "u3", "wrapped": old.sealer.seal(b"3" * 32)}))  # as earlier versions wrote
    table = spark.createDataFrame([(n,) for n in [*names, None]], "subject_id string")

    def write(w):
        own = FileKeyring(spark, path, b"k" * 32)
        return own.issue(table) if w % 2 else {n: own.key_for(n) for n in names}

    with ThreadPoolExecutor(4) as pool:
        said = [x for x in pool.map(write, range(4)) if x]
    ring = {r.subject_id: bytes(r.key) for r in old.frame().collect()}
    assert len(ring) == old.frame().count() == 24 and ring["u3"] == b"3" * 32
    assert all(x == ring for x in said) and {n: old.get(n) for n in names} == ring
    assert old.delete("u3") and not old.delete("u3") and old.delete("u4") and old.get("u3") is None and old.get("u4") is None and old.frame().count() == 22


def test_a_number_used_before_does_not_count(spark, tmp_path):
    from chronofact.sources import files
    from chronofact.sources.keyring import FileKeyring

    ring = FileKeyring(spark, str(tmp_path), b"k" * 32)
    key = ring.put("u1", b"1" * 32)
    part = ring._part_of("u1")
    ring.delete("u1")
    assert ring._last(part) == (2, {}) and files.publish(spark, ring._file(part, 1), '{"subject_id":"u1","wrapped":"x"}\n')  # by a writer that was slow
    assert not ring._counts(part, 1) and ring._numbers(part) == {part: [2]} and ring.get("u1") is None and key == b"1" * 32


def test_the_chain_is_built_in_parts(spark, monkeypatch):
    from chronofact.functions.digest import GENESIS
    from chronofact.operators import audit

    monkeypatch.setattr(audit, "PART", 300)
    rows = spark.range(2000).select((F.col("id") * 3 + 1).alias("seq"), F.lit("asserted").alias("kind"), F.concat(F.lit("f"), "id").alias("ref"), F.sha2(F.col("id").cast("string"), 256).alias("payload_hash")).orderBy(F.desc("seq"))
    entries = audit.build(rows)
    sizes = entries.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 2000
    prev, want = GENESIS, []
    for i in range(2000):
        h = hashlib.sha256(str(i).encode()).hexdigest()
        want.append((i * 3 + 1, "asserted", f"f{i}", h, prev, prev := hashlib.sha256((prev + h).encode()).hexdigest()))
    assert [tuple(r) for r in entries.orderBy("seq").collect()] == want
    later = audit.build_from(rows.where("seq > 3000"), want[999][5])
    assert sorted(tuple(r) for r in later.collect()) == want[1000:]
    assert audit.build(rows.limit(0)).count() == 0
    dense = audit.build(rows.withColumn("seq", ((F.col("seq") + 2) / 3).cast("bigint")))
    assert audit.verify_links(dense).head().ok and audit.verify_links(dense).head().entries == 2000


def test_one_call_of_the_stream_serves_many_keys():
    import pandas as pd

    from chronofact.streaming import ingest

    class State:
        value = None
        exists = property(lambda s: s.value is not None)
        get = property(lambda s: s.value)

        def update(self, value):
            self.value = value

    state, columns = State(), ["seq", "fact_id", "subject", "predicate", "object", "valid_from"]

    def batch(*rows):
        given = pd.DataFrame([(n, f"f{n}", s, "p", o, pd.Timestamp("2020-01-01")) for n, s, o in rows], columns=columns)
        out = pd.concat(list(ingest._changes((0,), iter([given]), state)))
        return sorted((int(a), None if pd.isna(b) else b) for a, b in zip(out["seq"], out["closes"]))

    assert batch((4, "u2", "x"), (1, "u1", "x"), (2, "u1", "x"), (3, "u1", "y")) == [(1, None), (3, "f1"), (4, None)]
    assert batch((5, "u1", "y"), (6, "u2", "y"), (7, None, "x"), (8, "u1", "x")) == [(6, "f4"), (7, None), (8, "f3")]


def test_nearest_vectors_of_odd_rows_and_many_parts(spark, monkeypatch):
    import math
    import random

    from chronofact.operators import recall

    monkeypatch.setattr(recall, "CELLS", 60)
    rng, nan, inf = random.Random(5), float("nan"), float("inf")
    some = lambda n: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(n)]
    rows = [(i, some(3), 0) for i in range(120)] + [(i, some(rng.choice([2, 3, 4])), 1) for i in range(120, 160)] + [(i, [1.0, 1.0], 2) for i in range(160, 200)]
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [nan, 1.0], 1), (203, [inf, 1.0], 1), (204, [], 1), (205, [1.0], None), (206, [1e200, 1.0], 1), (207, [2.0], 3)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")

    def score(a, b):
        if a is None or b is None or None in a[: min(len(a), len(b))] + b[: min(len(a), len(b))]:
            return None
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    want = []
    for i, q, label in rows:
        if i % 3 == 0 and label is not None:
            scored = [(score(v, q), j) for j, v, other in rows if other == label and j != i]
            place = lambda x: (2, 0, x[1]) if x[0] is None else (0, 0, x[1]) if math.isnan(x[0]) else (1, -x[0], x[1])
            want += [(i, n + 1, j) for n, (_, j) in enumerate(sorted(scored, key=place)[:5])]
    got = recall.vector_topk(table, table.where("vec_id % 3 = 0"), 5)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == sorted(want)

"""Every query against its SQL, small fixtures, tampering, and set forms against sequential folds."""

import random

import pytest

import __spark_entry__ as entry
from chronofact.engine import Engine
from chronofact.operators import audit, erase, govern, ingest, project, resolve
from chronofact.plans import catalogue
from tests.compare import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_is_its_sql(spark, name):
    assert differences(catalogue.QUERIES[name](spark, SF), connect(SF), catalogue.ORACLE[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_two_dated_messages(spark, tmp_path):
    m = Engine(spark, str(tmp_path), root_key=b"k" * 32)
    m.add("Hi, my name is Dana. I live in Delhi and I work at Acme.", "u1", "2019-01-01", "msg-1")
    m.add("I moved to Berlin and I joined Globex.", "u1", "2026-03-01", "msg-2")
    assert m.answer("where does the user lives_in", "u1") == "Berlin"
    assert m.answer("where did the user lives_in", "u1", as_of="2020-01-01") == "Delhi"
    rows = {r.object: r for r in m.timeline("u1").collect()}
    assert not rows["Delhi"].alive and rows["Delhi"].valid_to is not None and rows["Berlin"].alive
    src = m.provenance(rows["Berlin"].fact_id).head()
    assert src.snippet == "Berlin" and src.source_ref == "msg-2"
    assert m.conflicts().count() == 2
    assert m.verify_audit().ok and m.verify_audit(deep=True).ok
    dry = m.forget("u1", dry_run=True)
    real = m.forget("u1")
    assert dry["manifest_hash"] == real["manifest_hash"] and dry["signature"] is None
    assert real["episodes_deleted"] == 2 and real["facts_deleted"] == 5
    assert erase.verify(real, b"k" * 32) and not erase.verify(real | {"facts_deleted": 4}, b"k" * 32)
    assert m.is_forgotten("u1") and m.answer("lives_in", "u1") is None
    assert m.evidence().ok


def test_resolution_fixture(spark):
    names = spark.createDataFrame([(x,) for x in ("Acme", "Acme Corp", "Globex", "Globex Inc", "Berlin", "Paris")], "name string")
    auto = resolve.bands(resolve.pairs(names)).where("band = 'auto'").collect()
    assert {(r.canonical_id, r.alias_id) for r in auto} == {("Acme Corp", "Acme"), ("Globex Inc", "Globex")}


def test_unicode_extraction(spark):
    m = spark.createDataFrame([("u", "e", "Grüße 😀. I'm Zoë and I LIVE IN Łódź; i use Rust2, I use rust")], "subject_id string, episode_id string, text string")
    got = {(r.predicate, r.object, m.head().text[r.span_lo : r.span_hi]) for r in ingest.extract(m).collect()}
    assert got == {("name_is", "Zoë", "Zoë"), ("uses", "Rust2", "Rust2")}  # a value begins with A-Z


def test_exact_changes_is_the_sequential_fold(spark):
    rng, rows, want = random.Random(2), [], []
    for s in range(60):
        now, seq = None, 0
        for e in range(6):
            start, seen = now, set()
            for _ in range(rng.randint(1, 3)):
                o, seq = rng.choice("ABC"), seq + 1
                rows.append((f"s{s}", "p", f"s{s}-{e}", o, seq, "t"))
                if o in seen or o == start:
                    seen.add(o)
                    continue
                seen.add(o)
                if o != now:
                    want.append((f"s{s}", seq, o))
                    now = o
    df = spark.createDataFrame(rows, "subject string, predicate string, episode_id string, object string, seq bigint, valid_from string")
    assert sorted((r.subject, r.seq, r.object) for r in ingest.exact_changes(df).collect()) == sorted(want)


@pytest.mark.parametrize("column", ["object", "subject", "predicate", "confidence", "valid_from", "recorded_at", "episode_id", "subject_id"])
def test_tampering_is_found_at_its_place(spark, column):
    from pyspark.sql import functions as F

    log, entries = catalogue._log_and_entries(spark, "/root/testdata/sf0.001")
    kind = dict(log.dtypes)[column]
    forged = {"string": F.lit("forged"), "double": F.lit(0.5), "timestamp": F.lit("2001-01-01").cast("timestamp")}[kind]
    bad = log.withColumn(column, F.when(F.col("seq") == 42, forged).otherwise(F.col(column)))
    assert audit.verify_links(entries).head().ok
    assert audit.verify_deep(bad, entries).head().broken_at == 42
    assert audit.verify_links(entries.where("seq <> 42")).head().broken_at == 43


def test_fold_edge_cases(spark):
    rows = [(1, "invalidated", "x", None), (2, "asserted", "x", "A"), (3, "asserted", "y", "B"), (4, "invalidated", "y", None), (5, "asserted", "y", "C"), (6, "invalidated", "z", None)]
    from chronofact.sources.log import complete

    log = complete(spark.createDataFrame(rows, "seq bigint, op string, fact_id string, object string"))
    got = {r.fact_id: (r.object, r.alive, r.pos) for r in project.fold(log).collect()}
    assert got == {"x": ("A", True, 2), "y": ("C", True, 3)}


def test_sealed_rows_and_shredding(spark):
    keys = erase.Keys()
    [keys.key_for(s) for s in ("u1", "u2")]
    rows = spark.createDataFrame([("u1", "Delhi"), ("u2", "Chennai"), (None, "plain")], "subject_id string, object string")
    ring = keys.keyring(spark)
    sealed = erase.encrypt(rows, ring)
    assert {r.object for r in sealed.collect()} & {"Delhi", "Chennai"} == set()
    stored = spark.createDataFrame(sealed.collect(), sealed.schema)
    keys.shred("u1")
    assert {r.object for r in erase.decrypt(stored, keys.keyring(spark)).collect()} == {"Chennai", "plain"}


def test_governed_store():
    class Ledger:
        def __init__(self):
            self.said = []

        def add(self, text, subject_id):
            self.said.append("add")

        def forget(self, subject_id, requested_by, dry_run=False):
            self.said.append("dry" if dry_run else "forget")
            return {}

        def record_outcome(self, subject_id, deleted, verified):
            self.said.append((deleted, verified))

    class Store:
        def __init__(self, fails=False, lies=False):
            self.fails, self.lies, self.rows = fails, lies, {}

        def add(self, text, subject_id):
            self.rows.setdefault(subject_id, []).append(text)

        def delete(self, subject_id):
            if self.fails:
                raise OSError("down")
            if not self.lies:
                self.rows.pop(subject_id, None)

        def read(self, subject_id):
            return {"results": self.rows.get(subject_id, [])}

    for how, want in (({}, (True, True)), ({"lies": True}, (False, False)), ({"fails": True}, (False, False))):
        ledger = Ledger()
        g = govern.Governed(Store(**how), ledger)
        g.add("I live in Berlin.", "u1")
        receipt, _ = g.forget("u1")
        assert (receipt.complete, receipt.verified) == want and ledger.said[-1] == "forget"
    assert [govern.is_present(x) for x in (None, {}, {"results": []}, {"results": [1]}, [], [0], "x", {"other": 1})] == [False, False, False, True, False, True, True, True]


def test_commands_certificates_and_snapshots(spark, tmp_path, capsys):
    import json

    from chronofact import cli

    m = Engine(spark, str(tmp_path / "store"), root_key=b"k" * 32)
    m.add("I live in Delhi.", "u1", "2020-01-01")
    before = m.log().count()
    m.add("I moved to Berlin.", "u1", "2021-01-01")
    m.add("I'm Ravi.", "u2", "2021-01-01")
    assert [(r.object, r.alive) for r in m.edges(upto=before).collect()] == [("Delhi", True)]
    assert cli.main([], m) == 2 and cli.main(["verify", "--deep"], m) == 0
    assert cli.main(["verify", "--user", "u1"], m) == 1  # nothing is erased yet
    cert = m.forget("u1")
    assert m.edges(upto=before).count() == 0
    kept = m.certificates().head()
    assert kept.certificate_id == cert["certificate_id"] and kept.signature == cert["signature"] and kept.facts_deleted == 2
    assert cli.main(["verify", "--user", "u1"], m) == 0 and cli.main(["verify", "--user", "u2"], m) == 1
    assert cli.main(["evidence", "--out", str(tmp_path / "out"), "--deep"], m) == 0
    bundle = json.loads((tmp_path / "out" / "evidence.json").read_text())
    assert bundle["ok"] and [e["subject_id"] for e in bundle["register"]] == ["u1"] and len(bundle["certificates"]) == 1
    assert "u1" in (tmp_path / "out" / "EVIDENCE.md").read_text()
    assert "erased" in capsys.readouterr().out


def test_contents_are_sealed_and_shredded(spark, tmp_path):
    import glob

    from pyspark.sql import functions as F

    m = Engine(spark, str(tmp_path), root_key=b"k" * 32)
    m.backend.every = 1  # the fold is kept after each write, sealed as well
    assert len(m.add("Hi, my name is Dana. I live in Delhi.", "u1", "2019-01-01", "msg-1", agent_id="a", org_id="o")) == 2
    m.add("I'm Ravi and I live in Chennai.", "u2", "2021-01-01")
    m.add("I moved to Berlin.", "u1", "2021-01-01")
    m.add("I use Spark.", None)
    raw = b"".join(open(f, "rb").read() for f in glob.glob(f"{tmp_path}/**/*.parquet", recursive=True))
    assert b"Spark" in raw and not any(w in raw for w in (b"Delhi", b"Dana", b"Chennai", b"Berlin"))
    assert m.answer("where live", "u1") == "Berlin" and m.answer("where live", "u2") == "Chennai"
    scope = m.log().where("op = 'asserted' AND subject_id = 'u1'").select("agent_id", "org_id").first()
    assert (scope.agent_id, scope.org_id) == ("a", "o")
    assert m.verify_audit(deep=True).ok
    m.forget("u1", "dpo")
    assert m.keyring.get("u1") is None and m.keyring.get("u2") is not None
    assert m.answer("where live", "u1") is None and m.answer("where live", "u2") == "Chennai"
    assert m.log().where("subject_id = 'u1' AND op <> 'subject_forgotten'").isEmpty() and m.stored().where("subject_id = 'u1' AND op = 'episode'").count() == 2
    assert m.verify_audit().ok and m.verify_audit(deep=True).ok and m.evidence(deep=True).certificates == 1
    again = Engine(spark, str(tmp_path), root_key=b"k" * 32)
    assert [r.object for r in again.timeline("u2").collect()] == ["Ravi", "Chennai"]
    assert [r.object for r in again.timeline(subject="subject").collect()] == ["Spark"]
    with pytest.raises(Exception, match="(?i)tag|crypt"):
        Engine(spark, str(tmp_path), root_key=b"x" * 32).keyring.get("u2")
    again.keyring.delete("u2")  # without a tombstone: nothing excuses what is missing
    assert not again.verify_audit(deep=True).ok
    assert not spark.read.parquet(*glob.glob(f"{tmp_path}/fold/fold-*")).where(F.col("object") == "Chennai").count()
    with pytest.raises(ValueError):
        m.search("x", limit=0)
    with pytest.raises(ValueError):
        m.add("x", valid_from="not a date")


def test_writers_do_not_fork_the_chain(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(w):
        m = Engine(spark, str(tmp_path))
        for i in range(10):
            m.merge_entities(f"c{w}", f"a{w}-{i}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    m = Engine(spark, str(tmp_path))
    assert [r.seq for r in m.log().orderBy("seq").collect()] == list(range(1, 41)) and len(m) == 40
    found = m.verify_audit(deep=True)
    assert found.ok and found.entries == 40
    assert m.store.compact() and m.store.state().since == m.store.state().number and len(m.store.folders("log", m.store.state())) == 1
    m.merge_entities("d", "e")
    assert m.verify_audit(deep=True).ok and m.log().count() == 41
    m.truncate()
    assert len(m) == 0 and m.log().isEmpty()


def test_kept_fold_is_the_fold(spark, tmp_path):
    from chronofact.engine import KeptFold
    from chronofact.sources.log import complete

    rng = random.Random(3)
    rows = [(i + 1, rng.choice(["asserted", "invalidated"]), f"f{rng.randint(0, 9)}", rng.choice("ABC")) for i in range(60)]
    log = complete(spark.createDataFrame(rows, "seq bigint, op string, fact_id string, object string")).cache()
    kept = KeptFold(spark, str(tmp_path))
    for at in (7, 20, 41, 60):
        part = log.where(f"seq <= {at}")
        want = sorted(map(tuple, project.fold(part).select("fact_id", "object", "pos", "alive").collect()))
        assert sorted(map(tuple, kept.edges(part, at).select("fact_id", "object", "pos", "alive").collect())) == want
        kept.refresh(part, at)
        assert sorted(map(tuple, kept.edges(part, at).select("fact_id", "object", "pos", "alive").collect())) == want


def test_aliases_of_long_chains_and_rings(spark):
    rng = random.Random(4)
    rows = {f"a{i}": f"a{rng.randint(0, 400)}" for i in range(300)} | {f"c{i}": f"c{i + 1}" for i in range(1000)} | {"r0": "r1", "r1": "r2", "r2": "r0", "t0": "t1", "t1": "r1", "s": "s"}

    def walk(x):
        seen, at = [x], rows[x]
        while at in rows and at not in seen:
            seen.append(at)
            at = rows[at]
        return at

    table = spark.createDataFrame(list(rows.items()), "alias_id string, canonical_id string")
    assert {r.alias_id: r.resolved for r in project.alias_resolve(spark, table).collect()} == {x: walk(x) for x in rows}
    assert project.alias_resolve(spark, table.limit(0)).count() == 0


def test_more_than_a_million_aliases(spark):
    from pyspark.sql import functions as F

    pairs = spark.range(1_100_000).select(F.concat(F.lit("a"), "id").alias("alias_id"), F.concat(F.lit("a"), (F.col("id") - F.col("id") % 7 + F.least(F.col("id") % 7 + 1, F.lit(6)))).alias("canonical_id")).where("id % 7 <> 6")
    out = project.alias_resolve(spark, pairs)
    assert out.count() == pairs.count()
    assert out.where("CAST(substring(resolved, 2, 18) AS BIGINT) <> CAST(substring(alias_id, 2, 18) AS BIGINT) DIV 7 * 7 + 6").isEmpty()


def test_similar_names_lose_nothing(spark):
    rng = random.Random(6)
    parts = ["acme", "corp", "inc", "globex", "north", "south", "x", "ab", "data", "works", "Ünit", "ÉTÉ"]
    names = {" ".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(150)} | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(80)}
    table = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    want = {(r.a, r.b): r.score for r in resolve.pairs(table, blocks=3).collect() if round(r.score, 9) >= 0.5}
    assert {(r.a, r.b): r.score for r in resolve.similar(table).collect()} == want and len(want) > 300
    assert resolve.pairs(table, blocks=3).count() == len(names) * (len(names) - 1) // 2


def test_ports(spark, tmp_path):
    from chronofact import ports
    from chronofact.sources import keyring

    class Fault(Exception):
        status, retry_after = 503, None

    asked, slept = [], []

    def flaky():
        asked.append(1)
        if len(asked) < 4:
            raise Fault
        return "ok"

    assert ports.Retry(sleep=slept.append, chance=0).call(flaky) == "ok" and slept == [2, 4, 8]
    with pytest.raises(ValueError):
        ports.Retry(sleep=slept.append).call(lambda: int("x"))
    messages = spark.createDataFrame([("u1", "m1", "Delhi is home"), (None, "m2", None)], "subject_id string, source_ref string, text string")
    known = spark.createDataFrame([("m1", 0, "lives_in", "Delhi"), ("m1", 1, "likes", "Tea")], "source_ref string, pos int, predicate string, object string")
    replayed = {(r.subject, r.predicate, r.object, r.span_lo, r.span_hi) for r in ports.ReplayExtractor(known).extract(messages).collect()}
    assert replayed == {("u1", "lives_in", "Delhi", 0, 5), ("u1", "likes", "Tea", None, None)}
    model = ports.ModelExtractor(lambda t: [(None, "lives_in", w, 0.9) for w in t.split() if w.istitle()])
    assert [(r.subject, r.object, r.span_lo, r.confidence) for r in model.extract(messages).collect()] == [("u1", "Delhi", 0, 0.9)]
    m = Engine(spark, str(tmp_path / "m"), extractor=model, embedder=ports.ModelEmbedder(lambda ts: [[float(len(t)), 1.0] for t in ts], 2))
    m.add("Delhi", "u1", source_ref="m1")
    assert m.answer("lives", "u1") == "Delhi"
    assert isinstance(ports.default_extractor({}), ports.RuleExtractor) and ports.default_embedder({"CHRONOFACT_EMBEDDER": "no_such_module:make"}) is None
    assert keyring.root_key_from({}) is None and len(keyring.new_root_key()) == 32
    with pytest.raises(ValueError):
        keyring.root_key_from({"CHRONOFACT_ROOT_KEY": "eA=="})


def test_dense_vectors_are_the_sparse_ones(spark):
    from pyspark.sql import functions as F

    from chronofact import ports
    from chronofact.functions import vector as V

    texts = spark.createDataFrame([(1, "the cat the dog"), (2, ""), (3, None), (4, "u12 purchase k3")], "id int, text string")
    both = texts.join(V.vectors(texts, "id", "text"), "id", "left").select("id", V.dense(F.col("v"), F.col("square")).alias("a"), ports.HashEmbedder().column(F.col("text")).alias("b"))
    for r in both.collect():
        assert r.a == pytest.approx(r.b, abs=1e-12)


def test_adapters_http_and_settings():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from chronofact.sources.http import HTTPClient, HTTPFault

    said = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said.append((self.path, body))
            status, text = {"/add": (200, '{"id": 1}'), "/search": (200, "plain"), "/delete": (200, ""), "/get_all": (503, "down")}[self.path]
            self.send_response(status)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    c = HTTPClient(base)
    assert c.add("x", "u1") == {"id": 1} and c.search("q") == "plain" and c.delete("u1") is None
    with pytest.raises(HTTPFault) as fault:
        c.read("u1")
    assert fault.value.status == 503

    class Ledger:
        def add(self, text, subject_id):
            said.append(("ledger", text))

        def forget(self, subject_id, requested_by, dry_run=False):
            return {}

        def record_outcome(self, subject_id, deleted, verified):
            said.append(("outcome", deleted, verified))

    assert govern.from_environment({}, Ledger()) is None
    g = govern.from_environment({"CHRONOFACT_UPSTREAM": base, "CHRONOFACT_UPSTREAM_READ": ""}, Ledger())
    said.clear()
    g.add("hello", "u1")
    assert said[0] == ("ledger", "hello") and said[1][0] == "/add" and g.search("q") == "plain"
    receipt, _ = g.forget("u1")
    assert receipt.complete and receipt.verified is None
    server.shutdown()

    class Client:
        def insert(self, text, subject_id):
            return "in"

        def delete_all(self, subject_id):
            return None

        def get(self, subject_id):
            return []

    a = govern.adapter_for(Client())
    assert a.add("x", "u") == "in" and a.reads_back
    with pytest.raises(AttributeError):
        govern.Adapter(Client(), add="nothing")
    assert govern.Adapter(Client(), add=lambda client, text, subject_id: text * 2, search=None, delete="delete_all").add("x", "u") == "xx"

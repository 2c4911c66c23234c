"""Secret scan by multipart credential linking, with DataFrame functions only.

Base findings stand by themselves. Weak parts (an account name, an endpoint, a long
random-looking string) are reported only where complementary parts lie within one
scope: an access identifier and a secret, or an endpoint or account with a secret.
Parts meet by an interval join on (row, stretch of text); for it each stretch keeps
the first and last place of a role only, so a text with very many parts gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Kinds of findings in the order in which equal starts are listed.
BASE = {
    "assign": r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
WEAK = {
    "account": r"(?i:\b(?:user|username|login|account|client_id)[\"']?\x20*[:=]\x20*[\"']?)[A-Za-z0-9_.@-]{3,}",
    "endpoint": r"\b(?i:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@/?&=%+-]+",
    "opaque": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])",
}
#: Role of each kind in a credential.
ROLE = {"assign": "secret", "hex": "secret", "access": "id", "account": "id", "endpoint": "place", "opaque": "weak"}
#: Complementary roles: a weak kind counts where one of these lies in its scope.
NEEDS = {"account": ("secret",), "endpoint": ("secret",), "opaque": ("id", "place")}
SCOPE = 300
#: Entries of a list of spans that are worked on at once.
PART = 256
KINDS = [*BASE, *WEAK]


def _once(value: Column, use) -> Column:
    """use(value), with `value` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(items: Column) -> Column:
    """The array in parts of PART entries: work that grows with the square of a list's length is done inside parts only."""
    return _once(items, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART)), lambda i: F.slice(v, (i * PART + 1).cast("int"), F.lit(PART))))


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Spans of all matches, in code points: lengths of what lies between them and of the matches add up.

    Only a text that holds a match is split. The assign pattern is matched with values
    of any length, and those of fewer than six characters are dropped afterwards.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    both = F.zip_with(between, found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size"), b.alias("match")))
    parts = _parts(F.slice(both, F.lit(1), F.size(found)))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    step = lambda s, x: F.struct(
        (s["at"] + x["gap"] + x["size"]).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end"), x["match"].alias("match")))).alias("out"),
    )
    # What a step returns is copied whole, so the spans of earlier parts are not in it.
    own = lambda s, part: F.aggregate(part, F.struct(s["at"].alias("at"), none.alias("out")), step)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,match:string>>>").alias("done"))
    part_step = lambda s, part: _once(own(s, part), lambda r: F.struct(r["at"].alias("at"), F.concat(s["done"], F.array(r["out"])).alias("done")))
    spans = F.aggregate(parts, start, part_step, lambda s: F.flatten(s["done"]))
    if kind == "assign":
        spans = F.filter(spans, lambda x: F.length(F.regexp_extract(x["match"], pattern, 2)) >= 6)
    out = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_key, base, linked) of each row: arrays of (start, kind, end), in code points.

    Null and empty texts have none. Rows with the same doc_id are told apart by the
    hash of their text; repeated rows repeat. `linked` holds weak parts with a complement
    whose span begins or ends within `scope` characters of them, overlaps included; a weak
    part that lies within a base finding is that finding and not reported again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_key"),
        F.flatten(F.array(*[_spans(text, k, p) for k, p in BASE.items()])).alias("base"),
        F.flatten(F.array(*[_spans(text, k, p) for k, p in WEAK.items()])).alias("weak"),
    )
    rows = materialise(rows, "spans")  # the texts are scanned once; spans are small
    some = rows.where(F.size("weak") > 0).select(F.struct("doc_id", "text_key").alias("row"), "base", "weak").distinct()
    role = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(ROLE[k]))])
    parts = some.select("row", F.explode(F.concat("base", "weak")).alias("x")).select("row", role[F.col("x.kind")].alias("role"), "x.start", "x.end")
    # A part is known in each stretch that it touches; there only the outermost places of a role count.
    stretch = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("stretch")
    known = parts.select("row", "role", "start", "end", stretch).groupBy("row", "role", "stretch").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    needs = F.explode(F.array(*[F.struct(F.lit(KINDS.index(k)).alias("kind"), F.lit(r).alias("role")) for k, v in NEEDS.items() for r in v])).alias("n")
    pairs = docs.sparkSession.range(1).select(needs).select("n.kind", "n.role")  # a fixed handful of rows
    # What lies within a base finding: the two meet in the stretch that the weak part begins in.
    base = some.select("row", F.explode("base").alias("b"))
    touched = F.explode(F.sequence(F.floor(F.col("b.start") / scope), F.floor(F.col("b.end") / scope))).alias("b_stretch")
    base = base.select(F.col("row").alias("b_row"), F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"), touched)
    inside = F.expr("row = b_row AND x_stretch = b_stretch AND b_start <= x.start AND x.end <= b_end")
    weak = some.select("row", F.explode("weak").alias("x")).withColumn("x_stretch", F.floor(F.col("x.start") / scope))
    weak = weak.join(base, inside, "left_anti").drop("x_stretch")
    near = F.explode(F.sequence(F.floor(F.col("x.start") / scope) - 1, F.floor(F.col("x.end") / scope) + 1)).alias("stretch")
    asked = weak.select("row", "x", near).join(F.broadcast(pairs.withColumnRenamed("kind", "k")), F.col("x.kind") == F.col("k")).drop("k")
    met = asked.join(known, ["row", "role", "stretch"]).where((F.col("last") >= F.col("x.start") - scope) & (F.col("first") <= F.col("x.end") + scope))
    linked = met.groupBy("row").agg(F.collect_set("x").alias("linked"))
    linked = linked.select(F.col("row.doc_id").alias("l_id"), F.col("row.text_key").alias("l_key"), "linked")
    out = rows.join(linked, F.expr("doc_id <=> l_id AND text_key = l_key"), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return out.select("doc_id", "text_key", F.array_sort("base").alias("base"), F.coalesce(F.array_sort("linked"), none).alias("linked"))


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The counts of base kinds, the digest of base spans and all spans of each row."""
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return scan(docs, scope).select("doc_id", *[of(k) for k in BASE], F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.concat("base", "linked")).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """docs with each found span replaced by `mark` (overlapping ones by one), n_chars counted anew; all rows and columns stay.

    Rows without a finding are unchanged.
    """
    found = scan(docs, scope).where(F.size("base") + F.size("linked") > 0).select(
        F.col("doc_id").alias("f_id"),
        "text_key",
        F.array_sort(F.concat("base", "linked")).alias("found"),
    ).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    # Each step writes what lies before the span; a span that begins in the one before only prolongs it.
    # A part of the spans is worked on in its own stretch of the text (`seg`, which begins at `base`).
    def step(s, x):
        to = F.greatest(s["at"], x["end"])
        before = F.substring(s["seg"], s["at"] - s["base"] + 1, x["start"] - s["at"])
        out = F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], before, F.lit(mark)))
        return F.struct(to.alias("at"), out.alias("out"), s["seg"].alias("seg"), s["base"].alias("base"))

    def part_step(s, part):
        to = F.greatest(s["at"], F.array_max(F.transform(part, lambda x: x["end"])))
        begin = F.struct(s["at"].alias("at"), F.lit("").alias("out"), F.substring(text, s["at"] + 1, to - s["at"]).alias("seg"), s["at"].alias("base"))
        return F.struct(to.alias("at"), F.concat(s["out"], F.aggregate(part, begin, step, lambda r: r["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(_parts(F.col("found")), start, part_step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    joined = docs.withColumn("__key", F.xxhash64(text)).join(found, F.expr("doc_id <=> f_id AND __key = text_key"), "left")
    joined = joined.withColumn("text", F.when(F.col("found").isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("found").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)

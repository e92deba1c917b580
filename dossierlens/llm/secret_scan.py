"""Secret scans: all rules in one byte pass through a combined automaton.

Rules are compiled together into one minimal automaton (``automaton.py``) whose state after a byte tells which rules have a
match that ends there. The pass reads each byte once. Where a rule ends for the first time, its mirrored automaton finds the
leftmost begin and its own automaton the longest end; matches of one rule do not overlap. A match is kept if its value part
is long enough; one that is too short still uses up its bytes, as a regular expression that is filtered afterwards does.

The leftmost begin is exact for rules of which no match contains the begin of a later match that ends earlier; this holds for
prefix-and-value rules like those below.

A match of a rule with ``rest`` runs on over the key body that follows: to the END mark if one comes before the next BEGIN
mark, and else over the header and base64 lines that follow, so that a key cut off by the end of its text is covered too.

Defined results: null or empty text has no spans. Offsets are code points, end exclusive. Rows are scanned one by one;
other columns pass through, a column named like the output is replaced.
"""

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from dossierlens.llm.arrays import flat, pieces
from dossierlens.llm.automaton import Automaton, parse, reverse


@dataclass(frozen=True)
class Rule:
    """A match is ``prefix`` and then ``value``; it counts from ``least`` bytes of value on."""

    kind: str
    prefix: str
    value: str
    least: int
    fold_prefix: bool = False
    rest: bool = False


# The base rules, in the order in which kinds are listed, and well-known public key formats after them.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY", "-----", 5, rest=True),
)
RULES = BASE_RULES + MORE_RULES
SPAN = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


MARK = re.compile(rb"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
BODY = re.compile(rb"""(?:(?:[\s"'>#*+,]|\\[nrt])*(?:(?:Proc-Type|DEK-Info|Comment|Version):[^\n\\]*|[A-Za-z0-9+/=]{16,}))*"""
                  rb"""(?:(?:\r?\n|\\r|\\n)+[A-Za-z0-9+/]+=*(?=[\r\n\\"']|\Z))?""")


def body_end(data: bytes, end: int) -> int:
    """Where the key ends whose BEGIN mark ends at ``end``."""
    mark = MARK.search(data, end)
    return mark.end() if mark and mark[1] == b"END" else BODY.match(data, end).end()


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: tuple = RULES):
        trees = [("cat", [parse(r.prefix, r.fold_prefix), parse(r.value)]) for r in rules]
        self.rules = rules
        self.all = Automaton(trees, anywhere=True)
        self.forward = [Automaton([t], anywhere=False) for t in trees]
        self.backward = [Automaton([reverse(t)], anywhere=False) for t in trees]
        self.prefix = [Automaton([parse(r.prefix, r.fold_prefix)], anywhere=False) for r in rules]

    def scan(self, data: bytes) -> list:
        """(start, rule number, end) of the kept matches, in order; byte offsets."""
        table, limit, accepts = self.all.table, self.all.first_accepting, self.all.accepts
        state, at, done, found = self.all.start, 0, [0] * len(self.rules), []
        for byte in data:
            state = table[state + byte]
            at += 1
            if state >= limit:
                for number in accepts[state >> 8]:
                    if at <= done[number]:
                        continue
                    start = self.backward[number].longest_back(data, at, done[number])
                    if start < 0:
                        continue
                    end = done[number] = self.forward[number].longest(data, start)
                    if end - self.prefix[number].longest(data, start) >= self.rules[number].least:
                        found.append((start, number, end))
        found.sort()
        return found


def scan_secrets(docs: DataFrame, rules: tuple = RULES, text: str = "text", output: str = "secrets") -> DataFrame:
    """All rows and columns plus ``output``: array of (kind, start, end), by start and then rule order."""
    kept = docs.drop(output)
    schema = StructType([*kept.schema.fields, StructField(output, SPAN)])
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    def scanned(batches):
        scanner = shared.value
        for batch in batches:
            for piece in pieces(batch, text):
                data, starts = flat(piece.column(text))
                raw, bounds, counts, kinds, begins, ends = data.tobytes(), starts.tolist(), [0], [], [], []
                for first, last in zip(bounds, bounds[1:]):
                    own = raw[first:last]
                    spans = [(s, k, body_end(own, e) if rules[k].rest else e) for s, k, e in scanner.scan(own)]
                    if spans and not own.isascii():
                        spans = [(len(own[:s].decode()), k, len(own[:e].decode())) for s, k, e in spans]
                    for start, number, end in spans:
                        kinds.append(rules[number].kind)
                        begins.append(start)
                        ends.append(end)
                    counts.append(len(kinds))
                values = pa.StructArray.from_arrays(
                    [pa.array(kinds, pa.string()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())],
                    names=["kind", "start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*piece.columns, lists], names=schema.names)
    return kept.mapInArrow(scanned, schema)


def redact(found: DataFrame, text: str = "text", spans: str = "secrets", mask: str = "[SECRET]") -> DataFrame:
    """Replaces every span of ``text`` by ``mask``; spans that overlap or touch become one."""
    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("done"))
    step = F.aggregate(
        spans, empty,
        lambda acc, s: F.when(
            s["start"] > acc["done"],
            F.struct(F.concat(acc["text"], F.substring(F.col(text), acc["done"] + 1, s["start"] - acc["done"]), F.lit(mask)).alias("text"),
                     s["end"].alias("done")))
        .when((s["start"] == 0) & (acc["done"] == 0), F.struct(F.lit(mask).alias("text"), s["end"].alias("done")))
        .otherwise(F.struct(acc["text"].alias("text"), F.greatest(acc["done"], s["end"]).alias("done"))),
        lambda acc: F.concat(acc["text"], F.substring(F.col(text), acc["done"] + 1, F.length(text))))
    return found.withColumn(text, F.when(F.size(spans) > 0, step).otherwise(F.col(text)))


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs).select("doc_id", "secrets")

    def of(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("secrets")).alias("spans"))

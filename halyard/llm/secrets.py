"""Secrets in texts: three fixed patterns, and strings that two Markov models call random.

Character bigram models of random strings and of ordinary identifiers are
compared by the sum of log-likelihood ratios over a candidate string. Random
strings are learned from the values that the fixed patterns find in all rows,
mixed with the uniform model; ordinary ones in equal parts from the other runs of the same
characters in a bounded sample of rows (``sample_rows``, by hash) and from a labelled sample of
identifiers (``names``, by default those of Python's and Spark's own interfaces). Pairs that an
ordinary sample lacks get the share of their second character, so words that
the documents do not hold are not taken for random.

Defined cases: null text is empty and has no spans; empty tables give no rows
(and a model without counts, which is uniform on both sides and finds nothing);
repeated rows are scanned each; rows keep their other columns,
but columns named base or spans are replaced. Spans are in code
points, end exclusive. Spans of the fixed patterns are cut out of a string, and what is left on
either side is scored by itself if it has 20 characters. A string that is not random as a whole is
searched for random stretches, which are reported up to the next of ``/ = _ -`` on both sides.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Sequence
from importlib import import_module

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three kinds and their patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}

CANDIDATE_CHARS = "[A-Za-z0-9+/_=-]"
LEAST_LENGTH = 20
CANDIDATE = CANDIDATE_CHARS + f"{{{LEAST_LENGTH},}}"
ORDINARY = CANDIDATE_CHARS + "{4,}"
SAMPLE_ROWS = 2000
ALPHABET = 66
UNIFORM_SHARE = 0.5
SMOOTHING = 0.5
SINGLE_SHARE = 0.9  # of single characters in what unseen pairs get, the rest is uniform
NAMED_MODULES = [
    "argparse", "ast", "builtins", "collections", "datetime", "email.message", "http.client", "inspect", "json", "logging",
    "os", "pathlib", "pyspark.ml.classification", "pyspark.ml.feature", "pyspark.sql", "pyspark.sql.functions",
    "pyspark.sql.types", "shutil", "socket", "subprocess", "tempfile", "threading", "typing", "unittest", "urllib.request",
]
LEAST_RATIO = 12.0  # nats in favour of random
LEAST_MEAN = 0.5  # nats a bigram
RUNS = "halyard_candidate_runs"
SPANS = "array<struct<start:long,place:int,end:long,kind:string,found:string>>"


def _spans(text: Column, pattern: str, kind: str, place: int) -> Column:
    """All matches: what lies between them and they themselves give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # one more piece than matches: the last pair has no match
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("b"), found.alias("m"))

    def step(acc: Column, p: Column) -> Column:
        start = (acc["at"] + F.char_length(p["b"])).cast("long")
        end = (start + F.char_length(p["m"])).cast("long")
        span = F.struct(
            start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(kind).alias("kind"), p["m"].alias("found")
        )
        after = F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).cast(SPANS).alias("spans"))
        return F.when(p["m"].isNull(), acc).otherwise(after)

    empty = F.array().cast(SPANS)
    before = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, before, step, lambda acc: acc["spans"])).otherwise(empty)


def base_spans(text: Column) -> Column:
    spans = [_spans(text, pattern, kind, i) for i, (kind, pattern) in enumerate(KINDS.items())]
    long_enough = F.filter(spans[0], lambda s: F.char_length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 6)
    return F.array_sort(F.concat(long_enough, *spans[1:]))


def _pairs(tokens: DataFrame, token: str) -> DataFrame:
    """Counts of adjacent characters over all tokens, equal tokens counted together first."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    return (
        tokens.groupBy(token)
        .agg(F.count("*").alias("n"))
        .select("n", letters.alias("a"))
        .select("n", F.explode(F.arrays_zip(F.col("a"), F.slice("a", F.lit(2), F.size("a")).alias("b"))).alias("p"))
        .where(F.col("p.b").isNotNull())
        .groupBy(F.ascii("p.a").alias("a"), F.ascii("p.b").alias("b"))
        .agg(F.sum("n").alias("n"))
    )


def identifiers() -> list[str]:
    """Ordinary identifiers: public names of well-known modules and of their classes, alone and joined as names are.

    The labelled sample that ``train`` takes by default; it does not depend on the documents.
    """
    found = set(sys.stdlib_module_names)
    for name in NAMED_MODULES:
        module = import_module(name)
        for attribute in dir(module):
            found.add(attribute)
            if isinstance(getattr(module, attribute), type):
                found.update(dir(getattr(module, attribute)))
    names = sorted(n for n in found if n.isascii() and not n.startswith("_"))
    joined = []
    for i, name in enumerate(names):
        other = names[(i * 7919 + 1) % len(names)]
        joined += [f"{name}{joint}{other}" for joint in "_/-="]
        joined.append("".join(part[:1].upper() + part[1:] for part in f"{name}_{other}".split("_")))
    return names + joined


def _named(names: Sequence[str]) -> Counter:
    return Counter((ord(a), ord(b)) for name in names for a, b in zip(name, name[1:], strict=False))


def _backed_off(counts: dict) -> list[float]:
    """Probability of the second character after the first, at 128 * first + second.

    The share left to single characters grows with the number of different successors seen.
    """
    total = sum(counts.values())
    single, first, kinds = Counter(), Counter(), Counter()
    for (a, b), n in counts.items():
        single[b] += n
        first[a] += n
        kinds[a] += 1
    out = []
    for a in range(128):
        left = (kinds[a] + 1) / (first[a] + kinds[a] + 1)
        for b in range(128):
            alone = SINGLE_SHARE * single[b] / total + (1 - SINGLE_SHARE) / ALPHABET if total else 1 / ALPHABET
            out.append((1 - left) * counts.get((a, b), 0) / max(first[a], 1) + left * alone)
    return out


def train(docs: DataFrame, text: str, sample_rows: int = SAMPLE_ROWS, names: Sequence[str] | None = None) -> list[float]:
    """Log-likelihood ratio of each pair of characters, at 128 * first + second.

    The two tables of counts that reach the driver have at most ALPHABET**2 rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    values = docs.select(F.explode(base_spans(body)).alias("s")).select(
        F.when(F.col("s.kind") == "assign", F.regexp_extract("s.found", ASSIGN, 2)).otherwise(F.col("s.found")).alias("token")
    )
    random = values.select(F.explode(F.regexp_extract_all("token", F.lit(CANDIDATE_CHARS + "+"), F.lit(0))).alias("token"))
    rows = docs.count()
    share = min(1.0, sample_rows / max(rows, 1))
    sample = docs.select(body.alias("body")).where(F.pmod(F.xxhash64("body"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    for pattern in KINDS.values():
        sample = sample.withColumn("body", F.regexp_replace("body", pattern, " "))
    ordinary = sample.select(F.explode(F.regexp_extract_all("body", F.lit(ORDINARY), F.lit(0))).alias("token"))
    random_counts, plain_counts = ({(r.a, r.b): r.n for r in _pairs(tokens, "token").collect()} for tokens in (random, ordinary))
    random_first = Counter()
    for (a, _), n in random_counts.items():
        random_first[a] += n
    # without a count a sample says nothing: the other one stands for both
    plain = [_backed_off(c) for c in (plain_counts, _named(identifiers() if names is None else names)) if c]
    ratios = []
    for a in range(128):
        for b in range(128):
            learned = (random_counts.get((a, b), 0) + SMOOTHING) / (random_first[a] + SMOOTHING * ALPHABET)
            by_chance = UNIFORM_SHARE / ALPHABET + (1 - UNIFORM_SHARE) * learned
            at = 128 * a + b
            ratios.append(math.log(by_chance / (sum(p[at] for p in plain) / len(plain) if plain else 1 / ALPHABET)))
    return ratios


def ratio(token: Column, model: list[float]) -> Column:
    """Sum of the ratios over a string's adjacent characters."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    step = lambda acc, c: F.struct(
        F.ascii(c).alias("before"),
        (acc["sum"] + F.when(acc["before"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["before"] * 128 + F.ascii(c)))).alias("sum"),
    )
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    return F.aggregate(letters, start, step, lambda acc: acc["sum"])


def _outside(run: Column, base: Column) -> Column:
    """The parts of a run that no span of the base covers, of the least length of a candidate."""

    def part(start: Column, end: Column) -> Column:
        text = F.substring(run["found"], (start - run["start"] + 1).cast("int"), (end - start).cast("int"))
        made = F.struct(start.alias("start"), run["place"].alias("place"), end.alias("end"), run["kind"].alias("kind"), text.alias("found"))
        return F.when(end - start >= LEAST_LENGTH, F.array(made)).otherwise(F.array().cast(SPANS)).cast(SPANS)

    def step(acc: Column, b: Column) -> Column:
        after = F.struct(
            F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["parts"], part(acc["at"], F.least(b["start"], run["end"]))).alias("parts")
        )
        return F.when((b["start"] < run["end"]) & (run["start"] < b["end"]), after).otherwise(acc)

    before = F.struct(run["start"].alias("at"), F.array().cast(SPANS).alias("parts"))
    return F.aggregate(base, before, step, lambda acc: F.concat(acc["parts"], part(acc["at"], run["end"])))


def _stretches(run: Column, model: list[float]) -> Column:
    """Stretches of a run whose ratios exceed LEAST_MEAN by LEAST_RATIO in all.

    The excess is summed from left to right; a stretch ends at its peak when the sum has fallen to
    nothing, or by LEAST_RATIO.
    """
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    none = F.array().cast("array<struct<a:int,z:int>>")

    def ended(acc: Column) -> Column:
        enough = (acc["peak"] >= LEAST_RATIO) & (acc["z"] - acc["a"] >= LEAST_LENGTH)
        one = F.array(F.struct(acc["a"].alias("a"), acc["z"].alias("z")))
        return F.concat(acc["out"], F.when(enough, one).otherwise(none)).cast("array<struct<a:int,z:int>>")

    def state(before, i, a, z, total, peak, out) -> Column:
        columns = {"before": before, "i": i, "a": a, "z": z, "sum": total, "peak": peak, "out": out}
        return F.struct(*[c.alias(n) for n, c in columns.items()])

    def step(acc: Column, c: Column) -> Column:
        more = F.when(acc["before"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["before"] * 128 + F.ascii(c)) - LEAST_MEAN)
        total = acc["sum"] + more
        after = acc["i"] + 1
        higher = total > acc["peak"]
        on = state(F.ascii(c), after, acc["a"], F.when(higher, after).otherwise(acc["z"]), total, F.greatest(total, acc["peak"]), acc["out"])
        over = state(F.ascii(c), after, acc["i"], after, F.lit(0.0), F.lit(0.0), ended(acc))
        return F.when((total <= 0) | (total < acc["peak"] - LEAST_RATIO), over).otherwise(on)

    zero = F.lit(0)
    letters = F.filter(F.split(run["found"], ""), lambda c: c != "")
    found = F.aggregate(letters, state(F.lit(-1), zero, zero, zero, F.lit(0.0), F.lit(0.0), none), step, ended)

    def span(s: Column) -> Column:
        back = F.char_length(F.regexp_extract(F.substring(run["found"], F.lit(1), s["a"]), r"[A-Za-z0-9+]*$", 0))
        on = F.char_length(F.regexp_extract(F.substring(run["found"], s["z"] + 1, F.char_length(run["found"])), r"^[A-Za-z0-9+]*", 0))
        a, z = s["a"] - back, s["z"] + on
        return F.struct(
            (run["start"] + a).alias("start"),
            run["place"].alias("place"),
            (run["start"] + z).alias("end"),
            run["kind"].alias("kind"),
            F.substring(run["found"], a + 1, z - a).alias("found"),
        )

    return F.transform(found, span).cast(SPANS)


def find(docs: DataFrame, text: str, model: list[float]) -> DataFrame:
    """The rows with ``base`` (spans of the fixed patterns) and ``spans`` (all), in order."""
    body = F.coalesce(F.col(text), F.lit(""))
    runs = _spans(body, CANDIDATE, "random", len(KINDS))
    with_base = docs.withColumns({"base": base_spans(body), RUNS: runs})

    def is_random(s: Column) -> Column:
        return ratio(s["found"], model) >= F.greatest(F.lit(LEAST_RATIO), LEAST_MEAN * (s["end"] - s["start"] - 1))

    free = F.flatten(F.transform(RUNS, lambda s: _outside(s, F.col("base"))))
    random = F.flatten(F.transform(RUNS, lambda s: F.when(is_random(s), F.array(s)).otherwise(_stretches(s, model))))
    return (
        with_base.withColumn(RUNS, free)
        .withColumn(RUNS, F.array_distinct(random))
        .withColumn("spans", F.array_sort(F.concat("base", RUNS)))
        .drop(RUNS)
    )


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span (in order, perhaps overlapping) replaced by the mark."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"])
        .otherwise(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
        .alias("out"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    tail = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, tail)).otherwise(text)

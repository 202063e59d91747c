"""License scan by ordered signature rules, in Catalyst expressions only.

Several hundred regular expressions (``license_rules``) are gated by keywords: the distinct words of a text are
intersected with the gate words once, and only rules whose gate word is there are tried, so most texts cost one
hash lookup per word. Of those, only rules whose longest run of fixed words (the needle) stands in the text reach the
regular expression. A match is an interval of characters of the wrapped text with the rule's priority (1 is
strongest). Matches are walked by start, longest first; one inside the interval of a surviving match of the same
or a stronger priority is dropped. The walk is linear: it keeps the furthest end seen per priority.

``score`` is the largest confidence among surviving matches, at least that of a name if a base phrase occurs.

Defined results: null and empty texts have no words and no labels; repeated rows are scanned alike; all other
columns are ignored. The plan is a narrow projection of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.license_rules import CONFIDENCE, rules
from tessella.llm.native_text import count_of, find_all, let, running, wrapped_words

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
SPAN = "array<struct<start:int,stop:int,priority:int,label:string,confidence:double>>"


def wrapped(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def _words_in(part: Column) -> Column:
    return (count_of(part, " ") / 2).cast("long")


def gates_in(wrapped_text: Column) -> Column:
    """The gate words that occur."""
    return F.array_intersect(F.array(*[F.lit(g) for g in sorted({r.gate for r in rules()})]), F.split(wrapped_text, " +"))


def detections(wrapped_text: Column, present: Column) -> Column:
    """All matches of all rules whose gate word is present: sorted array of (start, -end, priority, label, confidence).

    ``present`` must be a column that is computed already: a lambda would compute an expression for every rule.
    """
    table = F.array(*[F.struct(F.lit(r.gate).alias("gate"), F.lit(r.needle).alias("needle"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence")) for r in rules()])
    tried = F.filter(table, lambda r: F.array_contains(present, r["gate"]) & F.contains(wrapped_text, r["needle"]))
    found = F.flatten(F.transform(tried, lambda r: F.transform(find_all(wrapped_text, r["pattern"]), lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("neg_end"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))))
    return F.when(F.size(present) > 0, F.array_sort(found))


def survivors(found: Column) -> Column:
    """Interval-containment suppression by priority: a detection goes if one before it, of the same or a stronger priority,
    reaches as far. (If that one goes itself, what covers it covers this one too.)"""
    level = lambda p: f"end{p}"
    reach = F.transform(found, lambda d: F.struct(*[F.when(d["priority"] <= p, -d["neg_end"]).otherwise(-1).alias(level(p)) for p in CONFIDENCE]))
    before = running(reach, F.struct(*[F.lit(-1).alias(level(p)) for p in CONFIDENCE]), lambda a, b: F.struct(*[F.greatest(a[level(p)], b[level(p)]).alias(level(p)) for p in CONFIDENCE]))

    def judged(d: Column, past: Column) -> Column:
        furthest = F.element_at(F.array(*[past[level(p)] for p in CONFIDENCE]), d["priority"])
        span = F.struct(d["start"].alias("start"), (-d["neg_end"]).alias("stop"), d["priority"].alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence"))
        return F.struct((furthest >= -d["neg_end"]).alias("covered"), span.alias("span"))

    return let(found, lambda every: F.transform(F.filter(F.zip_with(every, before, judged), lambda x: ~x["covered"]), lambda x: x["span"]))


def scan_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the surviving spans (over the wrapped text)."""
    words = documents.select("doc_id", wrapped_words(F.col("text")).alias("w"))
    w = F.col("w")
    counted = words.withColumn("present", gates_in(w)).withColumn("found", detections(w, F.col("present")))
    counted = counted.withColumn("n_words", _words_in(w)).withColumn("kept", survivors(F.col("found")))
    starts, ends, labels, total = [], [], [], F.lit(0).cast("long")
    for phrase, label in BASE.items():
        p, has = wrapped(phrase), w.contains(wrapped(phrase))
        total = total + F.when(has, count_of(w, p)).otherwise(0)
        starts.append(F.when(has, _words_in(F.substring_index(w, p, 1))))
        ends.append(F.when(has, F.col("n_words") - _words_in(F.substring_index(w, p, -1)) - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    kept = F.coalesce(F.col("kept"), F.array().cast(SPAN))
    best = F.coalesce(F.array_max(F.transform(kept, lambda k: k["confidence"])), F.lit(0.0))
    return counted.select(
        "doc_id",
        "n_words",
        total.alias("n_base"),
        F.least(*starts).alias("first_word"),
        F.greatest(*ends).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform(kept, lambda k: k["label"]))), ",").alias("labels"),
        F.greatest(best, F.when(F.size(base) > 0, CONFIDENCE[3]).otherwise(0.0)).alias("score"),
        kept.alias("spans"),
    )

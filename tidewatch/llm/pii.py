"""Personal data by candidate spans, boosted trees and calibrated thresholds.

Matches of the strict patterns are always taken. Generators with a high recall
propose more spans, which overlap: every run of whole digit groups of a fitting
length, addresses with other separators or with their signs spelled out. Boosted
trees judge them by format and context.

What the trees learn from is made of the table's own strict matches: each is written
in looser forms within its own surroundings, and the generators run over the result.
The span as a whole is a case for, every other span that cuts or overlaps it a case
against; so are spans in forms scrambled at random and what is proposed inside
matches that failed a validator. No loose example need be in the table. A threshold
per kind, set on held-out spans for a wanted precision, selects; of selected spans
of a kind that overlap the best stays. A kind with too few held-out cases selects none.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import boosting
from tidewatch.llm.registry import query, table
from tidewatch.llm.tables import col, materialize
from tidewatch.llm.text import annotate, fields, structs

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole, so a long one is walked once.
IP = re.compile(r"(?<![0-9])[0-9]++((?:\.[0-9]++){3})")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT = r"(?:\x20?[\[(]\x20?(?i:at|@)\x20?[\])]\x20?|\x20(?i:at)\x20|\x20@\x20?|@\x20)"
DOT = r"(?:\x20?[\[(]\x20?(?i:dot)\x20?[\])]\x20?|\x20(?i:dot)\x20|\x20?\.\x20?)"
LOOSE_MAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}")
LOOSE_IP = re.compile(r"(?<![0-9])(?=([0-9]{1,3}(\x20?(?:[\[(](?:\.|dot)[\])]|[-_,:.])\x20?)[0-9]{1,3}\2[0-9]{1,3}\2[0-9]{1,3})(?![0-9]))")
GROUP = re.compile(r"[0-9]+")
BETWEEN = re.compile(r"[\x20()./-]{1,3}")
GROUPS = 7                # digit groups of a loose number
CUES = {"email": ("mail", "contact"), "ip": ("ip", "host", "server", "addr"),
        "card": ("card", "visa", "credit", "pay"), "phone": ("tel", "phone", "call", "fax", "mobile")}
CONTEXT = 32
MARGIN = CONTEXT + 2      # text kept around a labelled span
TAUGHT = 128              # a longer strict match teaches nothing
AT_ONCE = 256             # windows whose views are made at once
BLOCK = 1 << 16           # cases of a block
PART = 1 << 18            # cases for which a level takes one more task
STEPS = 1024              # steps in a unit of the scores that thresholds are chosen from
PRECISION, LEAST, DEPTH = 0.98, 30, 4


class Found(NamedTuple):
    kind: int
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def strict(text: str) -> tuple[list[Found], list[Found]]:
    """Leftmost non-overlapping matches per kind: those that pass, and those that fail."""
    good, bad = [], []
    end = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        before = text[end:m.start()]
        start = end + len(before.rstrip(LOCAL))
        if start < m.start():
            end = m.end()
            good.append(Found(0, start, end))
    for m in IP.finditer(text):
        (good if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")) else bad).append(Found(1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            (good if 16 <= len(d) <= 19 and luhn(d) else bad).append(Found(2, *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        (good if 8 <= len(_digits(m[0])) <= 15 else bad).append(Found(3, *m.span()))
    return good, bad


def loose(text: str) -> Iterator[Found]:
    """Proposed spans; they may overlap. A number starts and ends with whole groups of digits."""
    if "@" in text or "at" in text or "AT" in text or "At" in text:
        for m in LOOSE_MAIL.finditer(text):
            yield Found(0, *m.span())
    for m in LOOSE_IP.finditer(text):
        if all(int(p) <= 255 for p in GROUP.findall(m[1])):
            yield Found(1, *m.span(1))
    open_: list[list[int]] = []  # start and digits of the runs that the next group may go on
    end = 0
    for m in GROUP.finditer(text):
        start, size = m.start(), m.end() - m.start()
        joined = size > 1 and open_ and start - end <= 3 and BETWEEN.fullmatch(text, end, start)
        open_ = [[at, n + size] for at, n in open_[-(GROUPS - 1):] if n + size <= 19] if joined else []
        open_.append([start, size])
        end = m.end()
        for at, n in open_ if size > 1 else ():
            if 7 <= n <= 19:
                first = at - (text[at - 1:at] == "(" and text.find(")", at, end) >= 0)
                if n <= 15:
                    yield Found(3, first, end)
                if n >= 13 and luhn(_digits(text[at:end])):
                    yield Found(2, first, end)


FEATURES = 27


def features(text: str, f: Found) -> list[float]:
    """Format and context of a span; digits of an address tell nothing."""
    span = text[f.start:f.end]
    sizes = [len(g) for g in GROUP.findall(span if f.kind else "")] or [0]
    left, right = text[max(0, f.start - CONTEXT):f.start], text[f.end:f.end + CONTEXT]
    cue, digits, between = left.lower(), sum(sizes), {c for c in span if not c.isalnum()}
    tail = span[len(span.rstrip(LOCAL)):] if f.kind == 0 else ""
    return [float(f.kind), float(len(span)), float(digits), float(len(sizes)), float(max(sizes)), float(min(sizes)),
            float(sizes[0]), float(sizes[-1]), float(span.count(" ")), float(span.count("-")), float(span.count(".")),
            float(span.count("(") - 0.5 * span.count(")")), float(span.startswith("(")), digits / len(span),
            float(len(between)), float(span.count(". ") + span.count(" .")),
            float(sum(c in "[(" for c in span)), float(" at " in span.lower()), float(" dot " in span.lower()),
            float(tail[:1].isupper()), float(any(c in cue for c in CUES[KINDS[f.kind]])),
            float(left[-1:].isalnum()), float(right[:1].isalnum()),
            float(any(c.isdigit() for c in left[-3:])), float(any(c.isdigit() for c in right[:3])),
            float(left[-1:] in between), float(right[:1] in between)]


def _scrambled(digits: str, draw: np.random.Generator) -> str:
    """The digits in groups of random sizes with random separators."""
    cuts = np.flatnonzero(draw.random(len(digits) - 1) < 0.3) + 1
    parts = [digits[a:b] for a, b in zip([0, *cuts], [*cuts, len(digits)])]
    return "".join(p + s for p, s in zip(parts, [*draw.choice([" ", "-", ".", "/"], len(parts) - 1), ""]))


def views(kind: int, span: str, words: list[str], draw: np.random.Generator) -> Iterator[tuple[str | tuple[str, str, str], bool]]:
    """A strict match in looser forms (true), some with text before and after, and what only looks like one (false)."""
    def some(forms: list[str], n: int) -> list[str]:
        return [str(x) for x in draw.choice(forms, n, replace=False)]

    groups = GROUP.findall(span)
    if kind == 0:
        local, domain = span.split("@", 1)
        for at in some([" (at) ", "(at)", " [at] ", "[at]", " at ", " @ ", "(@)"], 3):
            dot = some([".", ".", " dot ", " (dot) ", "[dot]"], 1)[0]
            yield local + at + domain.replace(".", dot), True
        if len(words) > 2:
            for at, stop in zip(some([" at ", " (at) ", " @ "], 2), some([". ", ".", " . "], 2)):
                first, second, third = some(words, 3)
                yield some([first, local[-64:]], 1)[0] + at + second + stop + third.capitalize(), False
    elif kind == 1:
        for dot in some(["-", "_", " . ", "[.]", "(dot)", "[dot]", ", ", ":"], 3):
            yield dot.join(groups), True
        yield some(["-", ", ", ":", " . "], 1)[0].join(map(str, draw.integers(0, 32, 4))), False
    elif kind == 2:
        digits = "".join(groups)
        parts = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        for between in some([".", "/", "  ", " - ", ". "], 2):
            yield between.join(parts), True
        other = "".join(str((int(c) + 3) % 10) for c in digits)
        yield (f"{other} ", span, ""), True  # beside another number, where the strict pattern takes both as one
        yield ("", span, f" {other}"), True
        yield _scrambled(digits, draw), False
    else:
        bare = span.lstrip("+ ")
        home = bare[len(groups[0]):].lstrip(" .-)")
        between = some([" ", "-", ".", "/"], 2)
        yield bare, True
        yield between[0].join(groups), True
        if len(groups) > 1 and len(_digits(home)) >= 7:
            yield home, True
            yield between[1].join(groups[1:]), True
            other = "".join(str((int(c) + 3) % 10) if c.isdigit() else c for c in home)
            for form in (home, between[1].join(groups[1:])):  # beside another number
                yield (f"{other} ", form, ""), True
                yield ("", form, f" {other}"), True
        yield _scrambled("".join(groups), draw), False
        yield _scrambled("".join(groups[1:] or groups), draw), False


def cases(kind: int, good: bool, text: str, at: int, size: int) -> Iterator[tuple[bool, list[float]]]:
    """Labelled cases of one window: what the generators propose over its views."""
    left, span, right = text[:at], text[at:at + size], text[at + size:]
    draw = np.random.default_rng(zlib.crc32(span.encode("utf-8", "replace")))
    words = re.findall(r"[A-Za-z]{2,}", left + " " + right)
    for form, true in views(kind, span, words, draw) if good else [(span, False)]:
        before, form, after = ("", form, "") if isinstance(form, str) else form
        whole, start = left + before + form + after + right, at + len(before)
        end = start + len(form)
        for f in dict.fromkeys(loose(whole)):
            if f.start < end and start < f.end:
                yield true and f == (kind, start, end), features(whole, f)


PROPOSED = fields(kind="integer[]", start="integer[]", end="integer[]", label="integer[]", x="float[]",
                  w_kind="integer[]", w_good="boolean[]", w_text="string[]", w_at="integer[]", w_size="integer[]", w_hash="long[]")


def proposed(texts: pa.Array) -> pa.Array:
    """Spans of each text, label 1: strict match, -1: to be judged by ``x``; and windows around labelled spans."""
    out: dict[str, list] = {f.name: [] for f in PROPOSED}
    for text in texts.to_pylist():
        row: dict[str, list | array] = {name: [] for name in out}
        row["x"] = array("f")
        if text and not text.isalpha():
            good, bad = strict(text)
            starts, ends = [], []
            for f in sorted(good, key=lambda f: f.start):
                if ends and f.start < ends[-1]:
                    ends[-1] = max(ends[-1], f.end)
                else:
                    starts.append(f.start)
                    ends.append(f.end)
            for f in good:
                for name, value in zip(out, (*f, 1)):
                    row[name].append(value)
            for f in dict.fromkeys(loose(text)):
                i = bisect_right(ends, f.start)
                if i == len(ends) or starts[i] >= f.end:  # strict matches are taken already
                    for name, value in zip(out, (*f, -1)):
                        row[name].append(value)
                    row["x"].extend(features(text, f))
            for f, is_good in [*((f, True) for f in good), *((f, False) for f in bad)]:
                if f.end - f.start <= TAUGHT:
                    first = max(0, f.start - MARGIN)
                    span = f"{f.kind}{text[f.start:f.end]}".encode("utf-8", "replace")
                    for name, value in zip(list(out)[5:], (f.kind, is_good, text[first:f.end + MARGIN], f.start - first,
                                                           f.end - f.start, zlib.crc32(span))):
                        row[name].append(value)
        for name in row:
            out[name].append(np.array(row[name], dtype=np.float32) if name == "x" else row[name])
    return structs(PROPOSED, out)


class Judge(NamedTuple):
    trees: boosting.Boosted | None
    thresholds: tuple[float, ...]


def _windows(candidates: DataFrame) -> DataFrame:
    """One window of each different labelled span."""
    names = ["w_kind", "w_good", "w_text", "w_at", "w_size", "w_hash"]
    one = candidates.select(F.explode(F.arrays_zip(*names)).alias("w")).select("w.*")
    span = F.substring("w_text", F.col("w_at") + 1, F.col("w_size"))
    one = one.groupBy("w_kind", "w_good", span.alias("span")).agg(F.min(F.struct("w_text", "w_at", "w_size", "w_hash")).alias("w"))
    return one.select("w_kind", "w_good", "w.*")


def _cases(windows: DataFrame) -> DataFrame:
    """``(held, y, x, n)``: the different cases of all windows, and how many of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                found = [(r["w_hash"] % 4 == 3, int(label), x) for r in batch.slice(at, AT_ONCE).to_pylist()
                         for label, x in cases(r["w_kind"], r["w_good"], r["w_text"], r["w_at"], r["w_size"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*found) if found else ((),) * 3, (pa.bool_(), pa.int32(), pa.list_(pa.float32())))], names=["held", "y", "x"])

    return windows.mapInArrow(run, "held boolean, y int, x array<float>").groupBy("held", "y", "x").agg(F.count("*").alias("n"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, FEATURES).astype(float)


def _blocks(train: DataFrame, edges: list[np.ndarray]) -> RDD:
    """Cases of equal bins put together, as arrays of up to BLOCK of them."""
    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [b.tobytes() for b in boosting.binned(_matrix(batch.column(1)), edges)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins, pa.binary()), batch.column(2)], names=["y", "bins", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if held and (batch is None or sum(b.num_rows for b in held) + batch.num_rows > BLOCK):
                whole = pa.Table.from_batches(held)
                y, n = (whole.column(i).to_numpy().astype(float).tobytes() for i in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (b"".join(whole.column(1).to_pylist()), y, n)],
                                                 names=["bins", "y", "n"])
                held = []
            if batch is not None and batch.num_rows:
                held.append(batch)

    bins = train.select("y", "x", "n").mapInArrow(to_bins, "y int, bins binary, n long")
    bins = materialize(bins.groupBy("y", "bins").agg(F.sum("n").alias("n")), "pii-bins")
    # As many tasks as the cases need, not as many as the shuffle before had.
    bins = bins.coalesce(max(1, -(-bins.count() // PART)))
    return bins.mapInArrow(pack, "bins binary, y binary, n binary").rdd.map(lambda r: (
        np.frombuffer(r["bins"], np.uint8).reshape(-1, FEATURES), np.frombuffer(r["y"]), np.frombuffer(r["n"])))


def _held_scores(held: DataFrame, trees: boosting.Boosted) -> DataFrame:
    """``(kind, score, n, true)`` of all held-out cases, scores in steps of 1/STEPS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            score = np.floor(trees.margin(x) * STEPS) / STEPS
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(score), batch.column(0), batch.column(2)],
                                             names=["kind", "score", "y", "n"])

    scored = held.select("y", "x", "n").mapInArrow(run, "kind int, score double, y int, n long")
    return scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("true"))


def judge(candidates: DataFrame) -> Judge:
    """Fit on the views of all different spans, three quarters to train, one to calibrate."""
    table = materialize(_cases(materialize(_windows(candidates), "pii-windows")), "pii-cases")
    train, held = table.filter("NOT held"), table.filter("held")
    # Values of a feature are few: spans and their surroundings are short.
    cuts = [F.percentile(F.col("x")[i], boosting.PROBS.tolist(), F.col("n")).alias(f"c{i}") for i in range(FEATURES)]
    of_train = train.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("true"), *cuts).first()
    if not of_train["n"] or of_train["true"] in (0, of_train["n"]):
        return Judge(None, (np.inf,) * len(KINDS))
    edges = [np.unique(of_train[f"c{i}"]) for i in range(FEATURES)]
    trees = boosting.fit_blocks(_blocks(train, edges), edges, boosting.log_odds(of_train["true"] / of_train["n"]), depth=DEPTH)
    scores = _held_scores(held, trees).toArrow()  # as many rows as scores have steps
    kind, score, n, true = (scores.column(i).to_numpy() for i in range(4))
    return Judge(trees, tuple(boosting.threshold(score[kind == k], true[kind == k], PRECISION, LEAST, n[kind == k])
                              for k in range(len(KINDS))))


def best_apart(spans: list[tuple[float, int, int, int, int]]) -> list[int]:
    """Positions of selected ``(score, kind, start, end, position)``: by kind the best of any that overlap."""
    kept: dict[int, list[tuple[int, int]]] = {}
    out = []
    for _, kind, start, end, at in sorted(spans, key=lambda s: (s[1], -s[0], s[2] - s[3], s[2])):
        mine = kept.setdefault(kind, [])
        i = bisect_right(mine, (start, end))
        if (i == 0 or mine[i - 1][1] <= start) and (i == len(mine) or mine[i][0] >= end):
            mine.insert(i, (start, end))
            out.append(at)
    return out


def find_personal(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(row, base, spans)``: strict spans and all selected spans, by kind, then start.

    Spans count code points, end exclusive; those of unlike kinds may overlap. NULL counts as
    empty and has none; repeated rows get the same spans; an empty table, an empty one.
    """
    candidates = annotate(docs, text, PROPOSED, proposed, keep=keep).select("row", "found.*")
    candidates = materialize(candidates, "pii-candidates")
    shared = docs.sparkSession.sparkContext.broadcast(judge(candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, thresholds = shared.value
        limits = np.array(thresholds)
        for batch in batches:
            labels = batch.column(1).flatten().to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(-1, FEATURES).astype(float)
            chosen, open_ = labels == 1, np.flatnonzero(labels == -1)
            if trees is not None and len(open_):
                score = trees.margin(x)
                passed = np.flatnonzero(score >= limits[x[:, 0].astype(int)])
                which = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
                start, end = (batch.column(i).flatten().to_numpy() for i in (3, 4))
                texts: dict[int, list] = {}
                for i in passed.tolist():
                    at = int(open_[i])
                    texts.setdefault(int(which[at]), []).append((score[i], int(x[i, 0]), int(start[at]), int(end[at]), at))
                for spans in texts.values():
                    chosen[best_apart(spans)] = True
            lists = pa.ListArray.from_arrays(pa.array(batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py(), pa.int32()),
                                             pa.array(chosen))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "chosen"])

    whole = candidates.select(F.struct("row", "kind", "start", "end", "label").alias("row"), "label", "x", "start", "end")
    done = whole.mapInArrow(run, whole.select("row", F.array(F.lit(True)).alias("chosen")).schema)
    every = F.arrays_zip(F.col("row.kind").alias("kind"), F.col("row.start").alias("start"), F.col("row.end").alias("end"),
                         F.col("row.label").alias("label"), F.col("chosen").alias("chosen"))
    done = done.select(F.col("row.row").alias("row"), every.alias("every"))

    def picked(condition) -> Column:
        return F.sort_array(F.transform(F.filter("every", condition), lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))

    return done.select("row", picked(lambda s: s["label"] == 1).alias("base"), picked(lambda s: s["chosen"]).alias("spans"))


def written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op3_personal_data")
def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(i).__eq__)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("row.doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))

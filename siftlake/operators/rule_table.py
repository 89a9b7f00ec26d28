"""Rules that come as a table: any number of patterns against every line, through an index of required literals.

A pattern cannot match a line without one of its literals, or one of several where it has alternatives.  Literals are
looked for in the lower-cased line and in the line with every run of marks and white space written as one space, so a
literal may go on over what separates words.  Every literal enters the index under one of its grams, the one that fewest
literals share.  The bytes of many lines are read at once for these grams; of a small index the whole literals behind them are
told there too, of a larger one a line meets its entries by the grams.  Both are an equality join, and only the pairs that hold a
whole literal run the pattern, which is a column like any other: the plan has the same size for one rule and for a million.
Equal patterns run once.  Patterns without a literal are tried on every line that is neither too short nor too long for
them, a bounded group of them at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from re import _constants as sre  # the standard library's own parser: its tree is only read
from re import _parser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.operators.scan import LINE_END, to_lines
from siftlake.rules.model import jvm_regex
from siftlake.session import checkpointed

GRAM = 3
#: Longer literals are indexed under grams of so many letters, which fewer lines have.
LONG_GRAM = 6
#: An index of so many literals goes to all executors; a larger one is shuffled with the lines' grams.
INDEX_ROWS = 200_000
#: Bits of the slot of a gram, and bytes of text that are read for grams at once.
_SLOT_BITS = 24
_STRETCH = 1 << 20
_GROUP = 128
_SEPARATORS = {c for c in range(128) if not chr(c).isalnum() and c != ord("_")}
#: The same in lower-cased text.
_SEPARATOR_RUN = r"[\x00-\x2f\x3a-\x60\x7b-\x7f&&[^_]]+"
#: Literals that alternatives of a pattern are multiplied out to, at most.
_FORMS = 16


def _plain(codes: Iterable[int]) -> str:
    return "".join(map(chr, codes)).lower()


def _better(one: list[str] | None, other: list[str] | None) -> list[str] | None:
    """Of two requirements the more selective: its shortest literal is longer, then it has fewer alternatives."""
    if not one or not other:
        return one or other
    return max(one, other, key=lambda x: (min(map(len, x)), -len(x)))


def _required(tree) -> list[str] | None:
    """Literals of which every match holds at least one; None where nothing is certain."""
    best, run = None, []

    def close() -> None:
        nonlocal best, run
        best = _better(best, [_plain(run)] if len(run) >= GRAM else None)
        run = []

    for kind, value in tree:
        if kind is sre.LITERAL and 32 <= value < 127:
            run.append(value)
            continue
        if kind is sre.AT:
            continue
        if kind is sre.SUBPATTERN and all(k is sre.LITERAL and 32 <= v < 127 for k, v in value[-1]):
            run += [v for _, v in value[-1]]
            continue
        close()
        if kind is sre.SUBPATTERN:
            best = _better(best, _required(value[-1]))
        elif kind is sre.BRANCH:
            parts = [_required(x) for x in value[1]]
            best = _better(best, None if any(x is None for x in parts) else sorted({y for x in parts for y in x}))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            best = _better(best, _required(value[2]))
        elif kind is sre.ATOMIC_GROUP:
            best = _better(best, _required(value))
    close()
    return best


def required_literals(pattern: str) -> list[str]:
    """Lower-case ASCII literals of at least three letters of which every match of a Java pattern holds one, whatever its case.

    Empty where none is certain, also for what Java and Python write differently: such a rule is tried on every line.
    """
    tree = _tree(pattern)
    return [] if tree is None else _required(tree) or []


def _separates(kind, value) -> bool:
    """Whether an item of a pattern matches one separator and nothing else."""
    if kind is sre.LITERAL:
        return value in _SEPARATORS
    if kind is not sre.IN:
        return False
    return all(
        k is sre.LITERAL and v in _SEPARATORS or k is sre.CATEGORY and v is sre.CATEGORY_SPACE
        or k is sre.RANGE and all(c in _SEPARATORS for c in range(v[0], min(v[1], 128) + 1)) and v[1] < 128
        for k, v in value)


def _join(left: set[str], right: set[str]) -> set[str]:
    """Every left part with every right one; separators that meet are one space."""
    return {a + (b[1:] if a[-1:] == " " and b[:1] == " " else b) for a in left for b in right}


def _forms(kind, value) -> set[str] | None:
    """All that an item of a pattern can match, with a space for each run of separators; None for too many."""
    if kind is sre.AT:
        return {""}
    if _separates(kind, value):
        return {" "}
    if kind is sre.LITERAL:
        return {chr(value).lower()} if 32 <= value < 127 else None
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, inner = value
        once = _sequence(inner)
        if once is None or not (high == 1 or once == {" "}):
            return None
        return once if low > 0 else {"", *once}
    if kind is sre.SUBPATTERN:
        return _sequence(value[-1])
    if kind is sre.ATOMIC_GROUP:
        return _sequence(value)
    if kind is sre.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        return None if any(x is None for x in parts) else set().union(*parts)
    return None


def _sequence(tree) -> set[str] | None:
    found = {""}
    for kind, value in tree:
        one = _forms(kind, value)
        if one is None or len(found) * len(one) > _FORMS:
            return None
        found = _join(found, one)
    return found


def _phrases(tree) -> list[str] | None:
    """As :func:`_required`, for text in which each run of separators is one space."""
    best, run = None, {""}

    def close(after: set[str]) -> None:
        nonlocal best, run
        best = _better(best, sorted(run) if all(len(x) >= GRAM for x in run) else None)
        run = after

    for kind, value in tree:
        one = _forms(kind, value)
        if one is not None and len(one) <= _FORMS:
            if len(run) * len(one) > _FORMS:
                close({""})
            run = _join(run, one)
            continue
        repeated = _sequence(value[2]) if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0 else None
        if repeated and len(run) * len(repeated) <= _FORMS:
            # The first of the repeats goes on from what stands before, the last one starts what stands behind.
            run = _join(run, repeated)
            close(repeated)
            continue
        close({""})
        if kind in (sre.SUBPATTERN, sre.ATOMIC_GROUP):
            best = _better(best, _phrases(value[-1] if kind is sre.SUBPATTERN else value))
        elif kind is sre.BRANCH:
            parts = [_phrases(x) for x in value[1]]
            best = _better(best, None if any(x is None for x in parts) else sorted({y for x in parts for y in x}))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            best = _better(best, _phrases(value[2]))
    close({""})
    return best


def _tree(pattern: str):
    """The parsed pattern; None for what Java and Python write differently."""
    bare = re.sub(r"\\.", "", pattern, flags=re.DOTALL)
    if "&&" in bare or re.search(r"\[[^\]]*\[|\(\?[a-zA-Z]*[xudU]", bare):
        return None
    try:
        return _parser.parse(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
    except (re.error, OverflowError, RecursionError, ValueError):
        return None


def indexed_literals(pattern: str) -> list[str]:
    """The more selective of :func:`required_literals` and literals that go on over separators, which a space stands for."""
    tree = _tree(pattern)
    return [] if tree is None else _better(_phrases(tree), required_literals(pattern)) or []


def line_length(pattern: str) -> tuple[int, int | None]:
    """Letters that a matching line has at least, and at most where the pattern is tied to both ends."""
    tree = _tree(pattern)
    if tree is None:
        return 0, None
    low, high = tree.getwidth()
    items = list(tree)
    tied = len(items) > 1 and items[0] == (sre.AT, sre.AT_BEGINNING) and items[-1] == (sre.AT, sre.AT_END) and not tree.state.flags & re.MULTILINE
    # An end may be followed by a line end of two letters.
    return low, high + 2 if tied and high < 1 << 30 else None


def compile_rules(rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Add ``jvm``, the pattern as it runs and null where it does not compile, ``literals``, ``shortest`` and ``longest`` line to a table of rules.

    Patterns match without regard to case and with ASCII word boundaries.  A null pattern does not compile.
    """
    @F.pandas_udf("struct<jvm:string,literals:array<string>,shortest:int,longest:int>")
    def read(patterns: pd.Series) -> pd.DataFrame:
        lengths = [(0, None) if p is None else line_length(p) for p in patterns]
        return pd.DataFrame({
            "jvm": [None if p is None else "(?i)" + jvm_regex(p) for p in patterns], "literals": [[] if p is None else indexed_literals(p) for p in patterns],
            "shortest": [min(a, 1 << 30) for a, _ in lengths], "longest": pd.array([b for _, b in lengths], "Int32")})

    ready = rules.withColumn("_r", read(F.col(pattern)))
    valid = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("_r.jvm")).isNotNull() & F.col("_r.jvm").isNotNull()
    return ready.withColumns({"jvm": F.when(valid, F.col("_r.jvm")), **{c: F.col(f"_r.{c}") for c in ("literals", "shortest", "longest")}}).drop("_r")


def rejected_rules(rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """The rules whose pattern does not compile, with all their columns."""
    return compile_rules(rules, pattern).filter("jvm IS NULL").select(*rules.columns)


def grams(text: Column, length: int = GRAM) -> Column:
    """The different grams of a text; none for a shorter one."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def searched(line: Column) -> Column:
    """The text in which literals are looked for: the lower-cased line, and the same with a space for each run of separators."""
    return F.concat(F.lower(line), F.lit("\n"), F.regexp_replace(F.lower(line), _SEPARATOR_RUN, " "))


def literal_index(compiled: DataFrame) -> DataFrame:
    """(gram, rule, which): every literal of every rule under its gram that fewest literals have."""
    literals = compiled.select("rule", F.posexplode("literals").alias("which", "literal"))
    own = F.when(F.char_length("literal") < LONG_GRAM, grams(F.col("literal"))).otherwise(grams(F.col("literal"), LONG_GRAM))
    each = literals.select("rule", "which", F.explode(own).alias("gram"))
    common = each.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", "gram")).alias("best")
    return each.join(common, "gram").groupBy("rule", "which").agg(rarest).select(F.col("best.gram").alias("gram"), "rule", "which")


def _codes(text: np.ndarray, length: int) -> np.ndarray:
    """The bytes of the gram that begins at each byte, as one number."""
    n = max(0, len(text) - length + 1)
    code = np.zeros(n, np.uint64)
    for k in range(length):
        code |= text[k:k + n].astype(np.uint64) << np.uint64(8 * k)
    return code


def _slots(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _bytes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all lines one after the other, and where each begins and the last one ends."""
    lines = lines.cast(pa.large_binary())
    at = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + len(lines) + 1]
    return np.frombuffer(lines.buffers()[2] or b"", np.uint8)[at[0]:at[-1]] if len(lines) else np.zeros(0, np.uint8), at - at[0]


def _spaced(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same lines with a space for each run of separators."""
    separates = np.zeros(256, bool)
    separates[list(_SEPARATORS)] = True
    mark = separates[text]
    kept = np.ones(len(text), bool)
    kept[1:] = ~(mark[1:] & mark[:-1])
    kept[ends[:-1][ends[:-1] < len(text)]] = True
    return np.where(mark, np.uint8(32), text)[kept], ends - np.searchsorted(np.flatnonzero(~kept), ends)


def _in_parts(lines: pa.Array, read: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """What ``read`` gives for some lines after the others, so that what it holds beside the text does not grow with long lines in a batch."""
    _, ends = _bytes(lines)
    cuts = [0, *(np.flatnonzero(np.diff(ends[:-1] // (4 * _STRETCH))) + 1).tolist(), len(lines)]
    parts = [read(lines.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.concat_arrays(parts)


def _candidates(text: np.ndarray, length: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a gram begins whose slot is marked, and the grams' numbers; a stretch of text at a time."""
    places, found = [], []
    for a in range(0, len(text), _STRETCH):
        codes = _codes(text[a:a + _STRETCH + length - 1], length)
        at = np.flatnonzero(marked[_slots(codes)])
        places.append(at + a)
        found.append(codes[at])
    return np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.uint64)])


def _lists(line: np.ndarray, which: np.ndarray, names: pa.Array, lines: int) -> pa.Array:
    """For each line the different names of its pairs."""
    pairs = np.unique(line * np.int64(max(1, len(names))) + which)
    counts = np.bincount(pairs // max(1, len(names)), minlength=lines)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), names.take(pa.array(pairs % max(1, len(names)))))


class _Literals:
    """Literals by their grams; ``of`` tells those that lines hold."""

    def __init__(self, pairs: list[tuple[str, str]]):
        pairs = sorted(pairs)
        self.names = pa.array([x for _, x in pairs], pa.string())
        text = [x.encode() for _, x in pairs]
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.size = np.array([len(x) for x in text], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.before = np.array([x.find(g.encode()) for (g, _), x in zip(pairs, text, strict=True)], np.int64)
        self.grams, self.marks = {}, {}
        for length in {len(g) for g, _ in pairs}:
            own = np.array([k for k, (g, _) in enumerate(pairs) if len(g) == length])
            codes = _codes(np.frombuffer("".join(pairs[k][0] for k in own).encode(), np.uint8), length)[::length]
            order = np.argsort(codes, kind="stable")
            self.grams[length] = codes[order], own[order]

    def of(self, lines: pa.Array) -> pa.Array:
        """For each lower-cased line the literals that it holds, also with a space for each run of separators."""
        text, ends = _bytes(lines)
        found = [self._pairs(*x) for x in ((text, ends), _spaced(text, ends))]
        return _lists(*map(np.concatenate, zip(*found, strict=True)), self.names, len(lines))

    def _pairs(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length, (codes, own) in self.grams.items():
            if length not in self.marks:
                self.marks[length] = np.zeros(1 << _SLOT_BITS, bool)
                self.marks[length][_slots(codes)] = True
            place, code = _candidates(text, length, self.marks[length])
            first, last = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
            # A gram stands for several literals.
            each = np.repeat(np.arange(len(place)), last - first)
            literal = own[np.arange(len(each)) - np.repeat(np.cumsum(last - first) - last, last - first)]
            begin = place[each] - self.before[literal]
            row = np.searchsorted(ends, begin, "right") - 1
            inside = begin >= 0
            inside[inside] = begin[inside] + self.size[literal[inside]] <= ends[row[inside] + 1]
            begin, literal, row = begin[inside], literal[inside], row[inside]
            k = 0
            while len(literal):
                over = self.size[literal] == k
                line.append(row[over])
                which.append(literal[over])
                begin, literal, row = begin[~over], literal[~over], row[~over]
                same = text[begin + k] == self.bytes[self.start[literal] + k]
                begin, literal, row = begin[same], literal[same], row[same]
                k += 1
        return np.concatenate(line), np.concatenate(which)


def _grams_of(lines: pa.Array, bitmap: bytes) -> pa.Array:
    """For each line its different grams whose slots are marked."""
    marked = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").view(bool)
    return _in_parts(lines, lambda some: _marked_grams(some, marked))


def _marked_grams(lines: pa.Array, marked: np.ndarray) -> pa.Array:
    text, ends = _bytes(lines)
    line, names, which, seen = [], [], [], 0
    for length in (GRAM, LONG_GRAM):
        place, code = _candidates(text, length, marked)
        row = np.searchsorted(ends, place, "right") - 1
        inside = place + length <= ends[row + 1]
        place, code, row = place[inside], code[inside], row[inside]
        codes, index = np.unique(code, return_inverse=True)
        raw = [c.tobytes()[:length] for c in codes]
        # Grams of literals are ASCII; others are marked by chance.
        names += [x.decode("ascii") if x.isascii() else None for x in raw]
        line.append(row)
        which.append(index + seen)
        seen += len(codes)
    return _lists(np.concatenate(line), np.concatenate(which), pa.array(names, pa.string()), len(lines))


def _slot_bitmap(index: DataFrame) -> bytes:
    """A bit for each slot, up where a gram of the index has it: of one size however many grams there are."""
    @F.arrow_udf("long")
    def slot(grams: pa.Array) -> pa.Array:
        text, ends = _bytes(grams)
        return pa.array([int(_slots(_codes(text[a:b], b - a))[0]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())

    part = 1 << 15
    rows = index.select(slot("gram").alias("s")).groupBy(F.expr(f"s div {part}").alias("k")).agg(F.bitmap_construct_agg(F.expr(f"s % {part}")).alias("bits")).collect()
    out = bytearray((1 << _SLOT_BITS) // 8)
    for k, bits in rows:
        out[k * part // 8:(k + 1) * part // 8] = bits
    return bytes(out)


def _keys(index: DataFrame, whole: bool):
    """A function that gives the keys of lower-cased lines: the literals that they hold, or grams, some of which may be no key of the index."""
    # Told apart from a plain expression, which a filter would compute a second time.
    if whole:
        literals = _Literals([tuple(r) for r in index.select("gram", "literal").distinct().collect()])
        return F.arrow_udf(lambda lines: _in_parts(lines, literals.of), "array<string>").asNondeterministic()
    bitmap = _slot_bitmap(index)
    return F.arrow_udf(lambda lines: _grams_of(lines, bitmap), "array<string>").asNondeterministic()


def scan_rules(corpus: DataFrame, rules: DataFrame, text: str = "text", pattern: str = "pattern", index_rows: int = INDEX_ROWS) -> DataFrame:
    """Findings of a table of rules over a corpus: one per line and rule, at the first match.

    Keeps all columns of the corpus but the text and all columns of the rules, and adds line_no, col_start, col_end and
    evidence.  Rows of ``rules`` are rules each, also where they are equal.  Rules that do not compile find nothing; see
    :func:`rejected_rules`.  Column names that both tables have are taken from the corpus.
    """
    rest = [c for c in corpus.columns if c != text]
    named = [c for c in rules.columns if c not in rest]
    # Rules are compiled once and written.  Equal patterns are one, which a number joins to the index and to its rules.
    compiled = checkpointed(compile_rules(rules, pattern).filter("jvm IS NOT NULL").select(F.struct(*named).alias("about"), "jvm", "literals", "shortest", "longest"))
    numbered = checkpointed(compiled.groupBy("jvm").agg(*[F.first(c).alias(c) for c in ("literals", "shortest", "longest")]).withColumn("rule", F.monotonically_increasing_id()))
    owners = compiled.select("about", "jvm")
    indexed = numbered.filter(F.size("literals") > 0)
    index = literal_index(indexed).join(indexed.select("rule", "jvm", "literals"), "rule").drop("rule").withColumn("literal", F.get("literals", F.col("which")))
    # Both sides go to all executors only while they have few rows; the stored table gives the planner no size.
    small = numbered.agg(F.coalesce(F.sum(F.greatest(F.size("literals"), F.lit(1))), F.lit(0))).first()[0] <= index_rows
    few = small and owners.count() <= index_rows

    def meet(rows: DataFrame, side: DataFrame, key: str, sent: bool = small) -> DataFrame:
        return rows.join(F.broadcast(side) if sent else side, key).drop(key)

    lines = to_lines(corpus.select(F.struct(*rest).alias("place"), F.col(text).alias("text")))
    low = F.lower("line") if small else searched(F.col("line"))
    keyed = lines.withColumn("low", low).select("place", "line_no", "line", *[] if small else ["low"], _keys(index, small)(F.col("low")).alias("keys"))
    met = keyed.select("*", F.explode("keys").alias("key"))
    joined = meet(met, index.withColumn("key", F.col("literal" if small else "gram")).drop("gram", "literal"), "key")
    # A line that holds several literals of a pattern is taken at the first of them alone.
    first = F.array_position(F.transform("literals", lambda x: F.array_contains("keys", x) if small else F.contains(F.col("low"), x)), True) - 1
    alone = F.lit(small) & (F.size("literals") == 1)
    # As a generator the place of a match is looked for once; as a column the filter would look for it again.
    tried = joined.filter(alone | (first == F.col("which"))).selectExpr("place", "line_no", "line", "jvm", "stack(1, regexp_instr(line, jvm)) AS start")
    found = tried.filter("start > 0")

    bare = numbered.filter(F.size("literals") == 0)
    count = bare.count()
    if count:
        parts = 1 + (count - 1) // _GROUP
        groups = bare.withColumn("g", F.pmod(F.xxhash64("rule"), F.lit(parts)).cast("int")).groupBy("g").agg(F.collect_list(F.struct("jvm", "shortest", "longest")).alias("rules"))
        # All lines of a text follow each other under one pattern, which is compiled once for them.
        numbered_lines = F.transform(F.split(text, LINE_END), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), F.char_length(x).alias("n")))
        texts = corpus.select(F.struct(*rest).alias("place"), numbered_lines.alias("lines"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("g"))
        each = meet(texts, groups, "g").select("place", "lines", F.explode("rules").alias("r"))
        fits = F.filter("lines", lambda x: (x["n"] >= F.col("r.shortest")) & (x["n"] <= F.coalesce("r.longest", x["n"])) & F.rlike(x["line"], F.col("r.jvm")))
        found = found.unionByName(each.select("place", "r.jvm", F.explode(fits).alias("x")).select("place", "x.line_no", "x.line", "jvm", F.regexp_instr("x.line", F.col("jvm")).alias("start")))
    matched = meet(found.withColumn("_jvm", F.col("jvm")), owners, "jvm", few)
    evidence = F.coalesce(F.regexp_substr("line", F.col("_jvm")), F.lit(""))
    return matched.select(
        *[F.col(f"place.{c}").alias(c) for c in rest], "line_no", *[F.col(f"about.{c}").alias(c) for c in named],
        F.col("start").alias("col_start"), (F.col("start") + F.char_length(evidence)).alias("col_end"), F.substring(evidence, 1, 120).alias("evidence"))

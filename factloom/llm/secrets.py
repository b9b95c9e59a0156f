"""Secret scans: fixed formats, and sliding-window Shannon entropy over candidate strings; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats, in the order in which kinds are listed. The group, if any, needs so many characters.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run is matched from its first AKIA or, if too short there, nowhere
HEX = r"[0-9a-f]{32,}"  # a run of this class is matched whole or not at all
KINDS = ("assign", "access", "hex", "entropy")

#: With "=" only where it pads: the name before an equals sign is no part of the value. A window needs WINDOW characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{18,}={0,2}"
#: Character classes from narrow to wide, and bits a character from which a window is random. A window of 20 of 16
#: symbols holds about 3.5 bits a character, of 62 or 64 symbols about 4.1.
CLASSES = (("lower hex", r"^[0-9a-f]+$", 3.0), ("upper hex", r"^[0-9A-F]+$", 3.0), ("alphanumeric", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^", 3.8))
#: A window of both letters and digits in one of the hex classes is held to this, whatever class its candidate has.
HEX_BITS = 3.0
#: A candidate in which no letter stands beside a digit is words and numbers joined by marks: a path, a name, a ruler.
MIXED = r"[A-Za-z][0-9]|[0-9][A-Za-z]"
#: Candidates that are no secrets: UUIDs. No pattern here repeats a group: Java matches such by recursion, once a round.
ALLOWED = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",)
WINDOW, UNIT = 20, 1_000_000
#: Windows folded at a time, and rows of an array gathered at a time.
BLOCK, CHUNK = 65_536, 256

SPAN = "struct<start:int,rank:int,end:int,first:int,last:int,text:string>"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(rows: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """An array of what ``emit`` (of type ``kind``) gives for each row and the state before it. Arrays are gathered in chunks of CHUNK and
    then joined, so that no row copies all earlier ones."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda k: F.slice(rows, k * CHUNK + 1, F.lit(CHUNK)))

    def chunk(s: Column, part: Column) -> Column:
        return F.aggregate(
            part, F.struct(s["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda t, r: F.struct(step(t["state"], r).alias("state"), F.concat(t["out"], F.array(emit(t["state"], r)).cast(f"array<{kind}>")).alias("out")),
            lambda t: F.struct(t["state"].alias("state"), F.concat(s["out"], F.array(t["out"])).alias("out")))

    done = F.aggregate(parts, F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), chunk, lambda s: F.flatten(s["out"]))
    return F.when(F.size(rows) > 0, done).otherwise(F.array().cast(f"array<{kind}>"))


def matches(text: Column, pattern: str, rank: int, group: int | None = None, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches: start and end in code points, first and last in bytes, ends exclusive.

    What stands between the matches gives the offsets: a split by the same pattern. If a group is named,
    matches whose group is under ``least`` characters go, after they have taken their place.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    rows = F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0)).alias("part"))
    sized = F.transform(rows, lambda r: F.struct(
        F.length(r["gap"]).alias("gap"), F.octet_length(r["gap"]).alias("gap_bytes"), F.length(r["hit"]).alias("hit"), F.octet_length(r["hit"]).alias("hit_bytes"), (F.length(r["part"]) >= least).alias("kept"), r["hit"].alias("text")))
    moved = lambda s, r: F.struct((s["at"] + r["gap"] + r["hit"]).alias("at"), (s["byte"] + r["gap_bytes"] + r["hit_bytes"]).alias("byte"))
    span = lambda s, r: F.struct(
        (s["at"] + r["gap"]).alias("start"), F.when(r["kept"], rank).otherwise(-1).alias("rank"), (s["at"] + r["gap"] + r["hit"]).alias("end"),
        (s["byte"] + r["gap_bytes"]).alias("first"), (s["byte"] + r["gap_bytes"] + r["hit_bytes"]).alias("last"), r["text"].alias("text"))
    found = let(sized, lambda x: running(x, F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte")), moved, span, SPAN))
    return F.when(text.rlike(pattern), F.filter(found, lambda s: s["rank"] >= 0)).otherwise(_none())


def _byte(binary: Column, at: Column) -> Column:
    """The byte at a place from 0, below 128: a cut of a binary, whose cost doesn't grow with the place."""
    return F.ascii(F.substring(binary, at + 1, F.lit(1)).cast("string"))


def _numbers(values: list[int], kind: str = "int") -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def random_part(candidate: Column, bits: Column, window: int, block: int = BLOCK) -> Column:
    """(first, last) place of windows of ``window`` characters with at least ``bits`` of entropy a character, or
    HEX_BITS in a window of hex letters of one case and digits; first -1 if none. Candidates are ASCII.

    With counts c, entropy is log2(window) - sum(c * log2(c)) / window. One count goes up and one goes down as
    the window moves, so the sum changes by two table look-ups. The counts are a byte a symbol. Windows are
    folded in blocks, each from its own beginning, so that memory doesn't grow with the candidate.
    """
    weight = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 2)]
    gain, loss = _numbers([weight[c + 1] - weight[c] for c in range(window + 1)], "long"), _numbers([weight[c] - weight[max(c - 1, 0)] for c in range(window + 1)], "long")
    code = _numbers([0 if 48 <= c <= 57 else 1 if 97 <= c <= 102 else 2 if 65 <= c <= 70 else 3 for c in range(128)])
    under = lambda least: F.floor((F.lit(math.log2(window)) - least) * window * UNIT)
    one = F.array(*[F.lit(bytes([c])) for c in range(window + 2)])
    step_type = "struct<counts:binary,total:bigint,first:int,last:int,digit:int,lower:int,upper:int,other:int>"
    put = lambda counts, at, count: F.overlay(counts, F.element_at(one, count + 1), at + 1, F.lit(1))

    def step(s: Column, r: Column, most: Column, most_hex: Column) -> Column:
        i, enter, leave = r["i"], r["enter"], r["leave"]
        # the leaving one goes first, so that counts stay within the window
        down = F.when(leave < 0, s["counts"]).otherwise(put(s["counts"], leave, _byte(s["counts"], leave) - 1))
        lost = F.when(leave < 0, F.lit(0).cast("long")).otherwise(F.element_at(loss, _byte(s["counts"], leave) + 1))

        def moved(counts: Column) -> Column:
            up = _byte(counts, enter)
            seen = {name: F.when(r["kind"] == k, i).otherwise(s[name]) for k, name in enumerate(("digit", "lower", "upper", "other"))}
            return F.struct(put(counts, enter, up + 1).alias("counts"), (s["total"] - lost + F.element_at(gain, up + 1)).alias("total"), *[v.alias(k) for k, v in seen.items()])

        def judged(m: Column) -> Column:
            within = {k: m[k] > i - window for k in ("digit", "lower", "upper", "other")}
            hexed = (m["total"] <= most_hex) & ~within["other"] & within["digit"] & (within["lower"] != within["upper"])
            full = (i >= window - 1) & ((m["total"] <= most) | hexed)
            return F.struct(m["counts"].alias("counts"), m["total"].alias("total"), F.when(full & (s["first"] < 0), i + 1 - window).otherwise(s["first"]).alias("first"), F.when(full, i + 1).otherwise(s["last"]).alias("last"), *[m[k].alias(k) for k in ("digit", "lower", "upper", "other")]).cast(step_type)

        return let(let(down, moved), judged)

    never = [F.lit(-window).alias(k) for k in ("digit", "lower", "upper", "other")]
    start = F.struct(F.lit(bytes(128)).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), *never).cast(step_type)

    def folded(part: Column, at: Column, most: Column, most_hex: Column) -> Column:
        letters = F.transform(F.sequence(F.lit(0), F.octet_length(part) - 1), lambda i: let(_byte(part, i), lambda b: F.struct(
            i.alias("i"), b.alias("enter"), F.when(i >= window, _byte(part, i - window)).otherwise(-1).alias("leave"), F.element_at(code, b + 1).alias("kind"))))
        return F.aggregate(letters, start, lambda s, r: step(s, r, most, most_hex), lambda s: F.struct(F.when(s["first"] >= 0, at + s["first"]).alias("first"), F.when(s["first"] >= 0, at + s["last"]).alias("last")))

    def whole(binary: Column, limits: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.octet_length(binary) - window, F.lit(0)), F.lit(block))
        parts = F.transform(starts, lambda at: let(F.substring(binary, at + 1, F.lit(block + window - 1)), lambda part: folded(part, at, limits["most"], limits["most_hex"])))
        return let(parts, lambda p: F.struct(F.coalesce(F.array_min(F.transform(p, lambda x: x["first"])), F.lit(-1)).alias("first"), F.coalesce(F.array_max(F.transform(p, lambda x: x["last"])), F.lit(-1)).alias("last")))

    limits = F.struct(under(bits).alias("most"), under(F.lit(HEX_BITS)).alias("most_hex"))
    return let(limits, lambda m: let(candidate.cast("binary"), lambda b: whole(b, m)))


def _class_bits(candidate: Column) -> Column:
    out = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        out = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks, one for each character, for what lies in ``spans`` (sorted by start)."""
    most = lambda s, r: F.struct(F.greatest(s["at"], r["end"]).alias("at"), F.greatest(s["byte"], r["last"]).alias("byte"))
    piece = lambda s, r: F.struct(s["byte"].alias("from"), F.greatest(r["first"] - s["byte"], F.lit(0)).alias("bytes"), F.greatest(r["end"] - F.greatest(s["at"], r["start"]), F.lit(0)).alias("blanks"))
    pieces = running(spans, F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte")), most, piece, "struct<from:int,bytes:int,blanks:int>")
    end = F.array_max(F.transform(spans, lambda s: s["last"]))
    return let(text.cast("binary"), lambda raw: F.concat(
        F.array_join(F.transform(pieces, lambda p: F.concat(F.substring(raw, p["from"] + 1, p["bytes"]).cast("string"), F.repeat(F.lit(" "), p["blanks"]))), ""),
        F.substring(raw, end + 1, F.octet_length(raw)).cast("string")))


def find_secrets(docs: DataFrame, text_col: str = "text", window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED, allowed_strings: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with secrets added: an array of (start, kind, end, text), by start and then kind.

    Offsets are code points of the whole text, end exclusive. The base kinds are ``assign``, ``access`` and ``hex``;
    ``entropy`` spans are added outside of them: runs of base64 characters ("=" at the end only), without what base
    spans cover, from the first to the last window as random as the run's character class asks, or as the hex class
    asks where the window is hex of letters and digits. Runs in which no letter stands beside a digit, and those that
    the allow-list (patterns, exact strings) holds, are left out. Null and empty texts have none. Time and memory grow
    with the text's length, whatever is in it. A column of the added name is replaced; all others stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.array_sort(F.concat(matches(text, ASSIGN, 0, group=2, least=8), matches(text, ACCESS, 1), matches(text, HEX, 2)))
    held = lambda c: F.reduce(F.array(*[F.lit(p) for p in allowed]).cast("array<string>"), F.lit(False), lambda a, p: a | F.rlike(c, p)) | c.isin(*allowed_strings)
    rest = F.when(F.size("__base") > 0, blanked(text, F.col("__base"))).otherwise(text)
    staged = docs.drop("secrets", "__base", "__some").withColumn("__base", base).withColumn("__some", let(rest, lambda t: matches(t, CANDIDATE, 3)))
    candidates = F.filter("__some", lambda c: c["text"].rlike(MIXED) & ~held(c["text"]))

    def narrowed(c: Column) -> Column:
        return let(random_part(c["text"], _class_bits(c["text"]), window), lambda p: F.struct(
            (c["start"] + p["first"]).alias("start"), F.when(p["first"] < 0, -1).otherwise(3).alias("rank"), (c["start"] + p["last"]).alias("end"),
            (c["first"] + p["first"]).alias("first"), (c["first"] + p["last"]).alias("last"), F.substring(c["text"], p["first"] + 1, p["last"] - p["first"]).alias("text")))

    random = F.when(F.size("__some") > 0, F.filter(F.transform(candidates, narrowed), lambda s: s["rank"] == 3).cast(f"array<{SPAN}>")).otherwise(_none())
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.array_sort(F.concat("__base", random)), lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["rank"] + 1).alias("kind"), s["end"].alias("end"), s["text"].alias("text")))
    return staged.withColumn("secrets", spans).drop("__base", "__some")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

"""Rules from tables: switched-off built-in rules, and custom rules of any number.

A few rules stay with the row: rule_hits() cuts the enabled custom rules by hash into groups of at
most GROUP_BYTES of patterns. A group is collected and broadcast; each Python worker makes one
automaton of it, through which Arrow batches of lowered texts run once. What comes back to the row
are the rules that hit; exemptions and findings are column functions again.

Rule tables without a bound are joined: hit_rows() and scored_rule_tables() broadcast no rules, only
filters of fixed size of their patterns' beginnings and wholes. Texts give the pieces that pass, by
rolling hashes over Arrow batches, and these meet the rules in an equality join of the bytes, so that
a filter's mistakes and hashes that fall together change no result.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.variants import bound
from logloom.operators.security import BASE, EXEMPTS, SAID, base_of, like, lower_ascii, scored, with_findings

#: Pattern bytes of one automaton; it takes about 60 bytes for each.
GROUP_BYTES = 2 << 20
KINDS = (*EXEMPTS, "keyword")
RULE = "struct<rule_type:string,kind:string,pattern:string,severity:string,action:string>"
#: The most 64-bit words of a filter, which then takes 16 MB and serves eight million patterns well.
MOST_WORDS = 1 << 21
#: Starts in a text that are looked at in one go.
STEP = 1 << 16
#: Longer beginnings are looked for only where their first bytes, so many, pass the filter.
COMMON = 16
#: Pairs of a place and a length that are looked at in one go.
PAIRS = 1 << 16
#: The most rows that one row of equal rules becomes in one go.
EQUAL = 1 << 12

#: A number for each byte, the same for both cases of a letter, and an odd base with its inverse modulo 2**64.
_NUMBERS = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_NUMBERS[ord("A") : ord("Z") + 1] = _NUMBERS[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPREAD, _AGAIN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@lru_cache(maxsize=32)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2**bits powers of the base and of its inverse."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full((1 << bits) - 1, x, np.uint64))) for x in (_BASE, _INVERSE))


class Sums:
    """Hashes of the windows of some bytes, by running sums; both cases of ASCII letters are equal."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _powers(int(len(data)).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_NUMBERS[data] * powers[: len(data)], out=self.sums[1:])

    def first(self, n: int, width: int) -> np.ndarray:
        """Of the windows that start at the first n places."""
        return self._mixed((self.sums[width : width + n] - self.sums[:n]) * self.inverse[:n], width)

    def at(self, places: np.ndarray, widths) -> np.ndarray:
        return self._mixed((self.sums[places + widths] - self.sums[places]) * self.inverse[places], widths)

    @staticmethod
    def _mixed(hashes: np.ndarray, widths) -> np.ndarray:
        mixed = (hashes + np.asarray(widths).astype(np.uint64)) * _SPREAD
        return (mixed ^ (mixed >> np.uint64(32))) * _AGAIN


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    """Three bits of a word for each hash, by other digits than those that choose the word."""
    return [np.uint64(1) << ((hashes >> np.uint64(k)) & np.uint64(63)) for k in (24, 12, 2)]


def _in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The numbers of the hashes that may be in a filter; few are looked at for more than one bit."""
    digits = hashes >> np.uint64(65 - len(words).bit_length())
    word = words.take(digits.view(np.int64))
    np.right_shift(hashes, np.uint64(24), out=digits)
    digits &= np.uint64(63)
    np.right_shift(word, digits, out=digits)
    digits &= np.uint64(1)
    first = np.nonzero(digits.astype(bool))[0]
    left = hashes[first]
    _, second, third = _bits(left)
    both = second | third
    return first[word[first] & both == both]


def beginning(lengths: np.ndarray) -> np.ndarray:
    """The greatest power of two within each length: so many bytes of a pattern are looked for first."""
    return np.left_shift(1, np.frexp(lengths)[1] - 1)


def beginnings(places: np.ndarray, lengths: np.ndarray):
    """Places and widths of the beginnings of patterns that are in a filter: the longest, and of those over COMMON the shorter ones from there."""
    longest, width = beginning(lengths), COMMON
    yield places, longest
    while (longer := longest > width).any():
        yield places[longer], np.full(np.count_nonzero(longer), width)
        width *= 2


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of texts, and the row ends in them."""
    texts = texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def _filter_bits(words: int):
    """Where patterns (low) set bits in filters of so many words: beginnings are 0, wholes are 1."""

    def run(batches):
        for batch in batches:
            data, ends = _buffers(batch.column(0))
            for row in np.split(np.arange(len(ends) - 1), np.nonzero(np.diff(ends[:-1] // STEP))[0] + 1):
                if not len(row):
                    continue
                start, lengths = ends[row[0]], ends[row + 1] - ends[row]
                sums, some = Sums(data[start : ends[row[-1] + 1]]), lengths > 0
                places, lengths = ends[row][some] - start, lengths[some]
                for which, which_places, widths in [(0, *own) for own in beginnings(places, lengths)] + [(1, places, lengths)]:
                    hashes = sums.at(which_places, widths)
                    mask = np.bitwise_or.reduce(_bits(hashes))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(hashes), which, np.int32)), pa.array((hashes >> np.uint64(65 - words.bit_length())).astype(np.int32)), pa.array(mask.view(np.int64))], ["which", "word", "mask"]
                    )

    return run


class Pieces:
    """Finds the pieces of texts that may be patterns: all that are, and few others."""

    def __init__(self, lengths: list[int], filters: np.ndarray):
        self.empty, self.filters = 0 in lengths, filters
        lengths = np.array(sorted(n for n in lengths if n), np.int64)
        self.longest, widths = int(lengths.max(initial=0)), beginning(lengths)
        self.by_width = {int(w): lengths[widths == w] for w in np.unique(widths)}
        self.everywhere = sorted({min(w, COMMON) for w in self.by_width})

    def wholes(self, sums: Sums, size: int, places: np.ndarray, width: int):
        """Places and lengths that may be patterns, of places where their beginnings of this width may be."""
        lengths = self.by_width.get(width, ())
        for k in range(0, len(places), max(1, PAIRS // len(lengths))) if len(lengths) else ():
            some = places[k : k + max(1, PAIRS // len(lengths))]
            at, widths = np.repeat(some, len(lengths)), np.tile(lengths, len(some))
            inside = at + widths <= size
            at, widths = at[inside], widths[inside]
            passed = _in_filter(self.filters[1], sums.at(at, widths))
            yield at[passed], widths[passed]

    def of_batch(self, texts: pa.Array) -> pa.Array:
        data, ends = _buffers(texts)
        found = [{b""} if self.empty and there else set() for there in texts.is_valid().to_pylist()]
        step = max(STEP, self.longest)
        for start in range(int(ends[0]), int(ends[-1]), step):
            some = data[start : min(int(ends[-1]), start + step + self.longest)]
            sums = Sums(some)
            for width in self.everywhere:
                n = min(step, len(some) - width + 1)
                places = _in_filter(self.filters[0], sums.first(n, width)) if n > 0 else np.zeros(0, np.int64)
                while len(places):
                    for at, lengths in self.wholes(sums, len(some), places, width):
                        rows = np.searchsorted(ends, at + start, "right") - 1
                        whole = at + start + lengths <= ends[rows + 1]
                        for place, length, row in zip(at[whole].tolist(), lengths[whole].tolist(), rows[whole].tolist()):
                            found[row].add(some[place : place + length].tobytes().lower())
                    width *= 2
                    if width <= COMMON or width > self.longest:
                        break
                    places = places[places + width <= len(some)]
                    places = places[_in_filter(self.filters[0], sums.at(places, width))]
        return pa.array([sorted(pieces) for pieces in found], pa.list_(pa.binary()))


@lru_cache(maxsize=2)
def pieces_finder(name: str, known: ByName) -> Pieces:
    return Pieces(*known.value)


class Automaton:
    """Finds which of the rules of a group a lowered text contains."""

    def __init__(self, rules: pa.Table):
        import ahocorasick

        self.rules = rules.select(["rule_type", "kind", "pattern", "severity", "action"]).combine_chunks().to_struct_array().combine_chunks()
        owners: dict[str, list[int]] = {}
        for k, low in enumerate(rules.column("low").to_pylist()):
            owners.setdefault(low, []).append(k)
        self.always = owners.pop("", [])  # every text contains the empty pattern
        self.words = ahocorasick.Automaton()
        for low, some in owners.items():
            self.words.add_word(low, some)
        self.words.make_automaton()

    def hits(self, text: str | None) -> list[int]:
        if text is None:
            return []
        found = set(self.always)
        if len(self.words):
            for _, some in self.words.iter(text):
                found.update(some)
        return sorted(found)

    def of_batch(self, texts: pa.Array) -> pa.Array:
        each = [self.hits(t) for t in texts.to_pylist()]
        ends = np.append(0, np.cumsum([len(e) for e in each])).astype(np.int32)
        chosen = self.rules.take(pa.array(np.array([k for e in each for k in e], np.int64)))
        return pa.ListArray.from_arrays(pa.array(ends), chosen)


@lru_cache(maxsize=4)
def automaton(name: str, rules: ByName) -> Automaton:
    """One for each group in a Python worker, which serves many tasks."""
    return Automaton(rules.value)


class ByName:
    """A broadcast that is known by a name, whatever copy of it a task holds."""

    def __init__(self, broadcast):
        self.name, self.broadcast = uuid.uuid4().hex, broadcast

    @property
    def value(self):
        return self.broadcast.value

    def __eq__(self, other) -> bool:
        return isinstance(other, ByName) and self.name == other.name

    def __hash__(self) -> int:
        return hash(self.name)


def finder(known: ByName):
    def run(texts: pa.Array) -> pa.Array:
        return automaton(known.name, known).of_batch(texts)

    return run


def enabled_rules(custom: DataFrame) -> DataFrame:
    """The rules that can take part, with their lowered pattern, kind, known severity and action."""
    enabled = F.when(F.col("rule_type") == "whitelist", F.col("enabled") == 1).otherwise(F.col("enabled") != 0)
    real = custom.filter(enabled & F.col("rule_type").isin("blacklist", "whitelist") & F.col("category").isin(*KINDS) & F.col("pattern").isNotNull())
    severity = F.when(F.col("severity").isin(*[s for s in BASE if s != "clean"]), F.col("severity")).otherwise("medium")
    return real.select(
        "rule_type", F.col("category").alias("kind"), "pattern", severity.alias("severity"), F.coalesce("action", F.lit("warn")).alias("action"), lower_ascii(F.col("pattern")).alias("low")
    )


def rule_hits(text: Column, custom: DataFrame, *, group_bytes: int = GROUP_BYTES) -> Column:
    """The enabled rules of custom(rule_type, category, pattern, severity, action, enabled) that a text contains.

    Equal rules hit once each. ASCII letters match in either case; an empty pattern is in every
    text, and a null text contains none.
    """
    spark, rules = custom.sparkSession, enabled_rules(custom)
    size = rules.agg(F.coalesce(F.sum(F.octet_length("low")), F.lit(0))).first()[0]
    groups = max(1, -(-5 * size // (4 * group_bytes)))  # a quarter spare, as a hash deals unevenly
    low, out = lower_ascii(text), []
    for group in range(groups):
        member = F.pmod(F.xxhash64("low"), F.lit(groups)) == group
        known = ByName(spark.sparkContext.broadcast(rules.filter(member).toArrow()))
        out.append(F.arrow_udf(finder(known), f"array<{RULE}>")(low))
    return F.concat(*out)


def pieces_of(text: Column, rules: DataFrame) -> Column:
    """The distinct pieces of a text, in lower case as bytes, that may be one of the patterns `low` of rules."""
    spark, low = rules.sparkSession, rules.select(F.col("low").cast("binary").alias("low"))
    counts = low.groupBy(F.octet_length("low").alias("n")).agg(F.approx_count_distinct("low").alias("patterns")).collect()  # a row for each length
    words = 1 << min(MOST_WORDS.bit_length() - 1, max(10, (sum(r["patterns"] for r in counts) // 4).bit_length()))
    bits = low.mapInArrow(_filter_bits(words), "which int, word int, mask long").groupBy("which", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    filters = np.zeros((2, words), np.uint64)
    filters[bits["which"].to_numpy(), bits["word"].to_numpy()] = bits["mask"].to_numpy().view(np.uint64)
    known = ByName(spark.sparkContext.broadcast(([r["n"] for r in counts], filters)))

    def run(texts: pa.Array) -> pa.Array:
        return pieces_finder(known.name, known).of_batch(texts)

    return F.arrow_udf(run, "array<binary>")(text)


def with_pieces(texts: DataFrame, text: Column, rules: DataFrame, *keys: Column | str) -> DataFrame:
    """keys and `low`: a row for each piece that may be a pattern of rules."""
    # an inner explode would have the pieces found again in the filter it adds
    return texts.select(*keys, F.explode_outer(pieces_of(text, rules)).alias("low")).filter("low IS NOT NULL")


def hit_rows(texts: DataFrame, text: Column, custom: DataFrame, *keys: str) -> DataFrame:
    """keys, rule_type, kind, pattern, severity, action: a row for each enabled rule of custom that a text contains.

    As rule_hits(), for rule tables without a bound. Equal rules are joined as one with their number,
    and become rows again, at most EQUAL at a time, when the texts and these parts are dealt out, so
    that neither a pattern of many rules nor one in many texts makes its rows in one task, or holds them.
    """
    rules = enabled_rules(custom)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rules.groupBy(*rules.columns).agg(F.count("*").alias("_n")).withColumn("low", F.col("low").cast("binary"))
    joined = with_pieces(texts, text, rules, *keys).join(counted, "low").drop("low")
    dealt = joined.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_n - 1) div {EQUAL})"))).repartition(parts, *keys, "_part")
    equal = F.least(F.lit(EQUAL).cast("long"), F.col("_n") - EQUAL * F.col("_part"))
    return dealt.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), equal))).drop("_k", "_part", "_n")


def scored_rule_tables(texts: DataFrame, builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """scored() of with_rule_tables(), for rule tables without a bound.

    What the rules of a pattern do is summed up by pattern, and then by text, so that rows grow with
    the texts and with the rules but not with the hits. A text is known by its SHA-256.
    """
    rules = enabled_rules(custom)
    white, black = F.col("rule_type") == "whitelist", F.col("rule_type") == "blacklist"
    spares = {k: F.bool_or(white & (F.col("kind") == k)).alias(k) for k in KINDS}
    by_low = rules.groupBy(F.col("low").cast("binary").alias("low")).agg(
        *spares.values(), F.count_if(black).alias("_n"), F.max(F.when(black, F.struct(base_of(F.col("severity")).alias("base"), "severity"))).alias("_worst"), F.bool_or(black & (F.col("action") == "block")).alias("_block")
    )
    key = F.sha2("text", 256).alias("_key")
    pieces = with_pieces(texts, F.col("text"), rules, key).distinct()
    by_text = pieces.join(by_low, "low").groupBy("_key").agg(*[F.bool_or(k).alias(k) for k in KINDS], F.sum("_n").alias("_n"), F.max("_worst").alias("_worst"), F.bool_or("_block").alias("_block"))
    found = with_findings(texts, disabled=switched_off(builtin), proof=False).select("id", key, "found").join(by_text, "_key", "left")
    free = [F.when(F.col(kind), F.array(*map(F.lit, categories))).otherwise(F.array().cast("array<string>")) for kind, categories in EXEMPTS.items()]
    kept = F.when(F.col("keyword"), F.slice("found", 1, 0)).otherwise(bound(F.concat(*free), lambda names: F.filter("found", lambda f: ~F.array_contains(names, f["category"]))))
    # one finding stands for all of custom rules, with the worst severity and a block if any asks for one
    worst = F.struct(F.lit("custom.blacklist").alias("rule_id"), F.lit("custom").alias("category"), F.col("_worst.severity").alias("severity"), F.when(F.col("_block"), "block").otherwise("warn").alias("action"), F.lit(None).cast("string").alias("evidence"))
    all_found = F.when(F.col("_n") > 0, F.concat(kept, F.array(worst))).otherwise(kept)
    rows = scored(found.select("id", all_found.alias("found"), F.when(F.col("_n") > 0, F.col("_n") - 1).otherwise(0).alias("_more")), keep=("_more",))
    return rows.withColumn("findings", F.col("findings") + F.col("_more")).drop("_more")


def switched_off(builtin: DataFrame) -> tuple[str, ...]:
    """The built-in rules that are off."""
    off = builtin.filter((F.col("enabled") == 0) & F.col("rule_id").isin(*SAID)).select("rule_id").distinct().collect()  # of 23
    return tuple(r["rule_id"] for r in off)


def with_rule_tables(texts: DataFrame, builtin: DataFrame, custom: DataFrame, *, only: str | None = None, group_bytes: int = GROUP_BYTES, **options) -> DataFrame:
    """with_findings() under the rule tables builtin(rule_id, enabled) and custom.

    A whitelist rule that the text contains exempts built-in findings: a keyword all of them, the
    others those of their kind's categories. Findings of blacklist rules are never exempt. Unknown
    severities are medium, no action is a warning, and rules of other categories never match.
    """
    found = with_findings(texts, disabled=switched_off(builtin), only=only, **options)
    kinds = [k for k in KINDS if only is None or like(f"custom.blacklist.{k}", only)]

    def of(hits: Column) -> Column:
        spared = lambda kind: F.exists(hits, lambda h: (h["rule_type"] == "whitelist") & (h["kind"] == kind))
        free = [F.when(spared(kind), F.array(*map(F.lit, categories))).otherwise(F.array().cast("array<string>")) for kind, categories in EXEMPTS.items()]
        kept = bound(F.concat(*free), lambda names: F.filter("found", lambda f: ~F.array_contains(names, f["category"])))
        black = F.filter(hits, lambda h: (h["rule_type"] == "blacklist") & h["kind"].isin(*kinds))
        entry = lambda h: F.struct(
            F.concat(F.lit("custom.blacklist."), h["kind"]).alias("rule_id"),
            F.lit("custom").alias("category"),
            h["severity"].alias("severity"),
            h["action"].alias("action"),
            h["pattern"].alias("evidence"),
        )
        return F.concat(F.when(spared("keyword"), F.slice("found", 1, 0)).otherwise(kept), F.transform(black, entry))

    return found.withColumn("_hits", rule_hits(F.col("text"), custom, group_bytes=group_bytes)).withColumn("found", bound(F.col("_hits"), of)).drop("_hits")

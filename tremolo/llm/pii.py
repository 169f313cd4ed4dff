"""PII by bootstrapped contextual extraction, in DataFrame functions only.

Base spans come from one pattern a kind, each with its check (numbers of an address, Luhn, digits).  The base
spans are the seeds, and so are credentials of known forms (kind ``secret``, reported apart).  The words around an
identifier-like token are its lexical patterns: the word to the left, the word to the right, both, each of them with
the token's shape, and the key of a ``key=value`` token.  Patterns and instances form a graph whose scores are
refined in turns: a pattern is as good as the share of its occurrences that hold known instances, an instance as good
as the patterns that extract it (noisy or).  High-confidence patterns then mark tokens that no base pattern matches,
unless the word on either side is known to introduce other things.

Defined results
* null text: no spans.  Null doc_id: an ordinary row.  Rows that repeat an id: one result row each.
* counts (n_email ...) and base_sha256 are of base spans, ``spans`` holds base and added ones of these kinds.
* ``secrets`` holds the spans of kind secret, seeds and learned ones: the whole token, key and value.
* an added span never overlaps a base span.  No rows: an empty result.  Extra columns are not read.
* the first token of a text has the left word ``^``, the last one the right word ``$``; words are lower-cased, digits
  in them are one 0, and a word of more than 64 characters stands in its pattern by its hash.
* an instance is the token in lower case, without the key of a ``key=value`` token.
* two kinds that claim a token: the surer pattern decides, then the first kind as listed.
* a token isn't marked if its left or right word has at least ``support`` occurrences beside tokens, of which no kind
  has a share of 1 - ``confidence``.

All patterns use possessive groups: matching is linear in the text and needs no recursion, whatever its length; matches
are placed in slices of ``SLICE``, so a text with very many costs about as much a match as one with few.  Skew: the
graph is summed by (pattern, instance) before any shuffle; scores are joined by pattern, where a very common word is
split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
# The base patterns, possessive where nothing can be given back.  A local part or a number is tried from
# its first character only (or from where the last match ended): if that fails, no later start succeeds.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WS = r"\x20\x09-\x0D"
#: Identifier-like tokens: no white space, at least four characters, a digit or an @ in them.
CANDIDATE = rf"(?<![^{_WS}])(?=[^{_WS}]{{4}})(?=[^{_WS}]*[0-9@])[^{_WS}]++"
# Published forms of credentials that serve as seeds (an access key id; usual names of keys).
SECRET = r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[=:][^\x20\x09-\x0D]{8,})"
#: The kind of credentials, after the base kinds.
SECRET_KIND = len(KINDS)
#: Rounds of scoring, and what a pattern needs to mark tokens: confidence, and distinct known instances.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.8, 5
#: Matches that are placed together.
SLICE = 128


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    n = F.length(_digits(m))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False)


_SPAN = "struct<kind:int,start:int,end:int>"
_TOKEN = "struct<start:int,end:int,token:string,seed:int,patterns:array<string>>"


def _nothing(kind: str) -> Column:
    return F.from_json(F.lit("[]"), f"array<{kind}>")


def _scan(text: Column, pattern: str, keep, item, kind: str) -> Column:
    """Array of ``item(match, piece before, match before, piece after, match after)`` with start and end in code points, of the matches that ``keep`` accepts."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def zipped(piece: Column, m: Column) -> Column:
        behind = F.concat(F.array(F.lit(None).cast("string")), m)
        after = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))
        return F.arrays_zip(m.alias("m"), piece.alias("piece"), behind.alias("behind"), after(piece).alias("after"), after(m).alias("next"))

    def place(slice_: Column) -> Column:
        """Length of a slice, and its items with places in it."""
        def step(acc: Column, x: Column) -> Column:
            start, m = acc["pos"] + F.char_length(x["piece"]), F.coalesce(x["m"], F.lit(""))
            end = (start + F.char_length(m)).cast("int")
            found = F.array(item(m, start.cast("int"), end, x))
            return F.struct(end.alias("pos"), F.when(x["m"].isNotNull() & keep(m), F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(slice_, F.struct(F.lit(0).alias("pos"), _nothing(kind).alias("out")), step)

    def joined(parts: Column) -> Column:
        at = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["pos"])))
        moved = lambda p, by: F.transform(p["out"], lambda x: x.withField("start", x["start"] + by).withField("end", x["end"] + by))
        return F.flatten(F.zip_with(parts, F.slice(at, F.lit(1), F.size(parts)), moved))

    # A one-element array binds what would be computed again at each place of a lambda.
    once = lambda x, f: F.transform(F.array(x), f)[0]
    slices = lambda z: F.transform(F.sequence(F.lit(1), F.greatest(F.size(z), F.lit(1)), F.lit(SLICE)), lambda i: place(F.slice(z, i, F.lit(SLICE))))
    whole = once(F.struct(pieces.alias("p"), matches.alias("m")), lambda x: once(zipped(x["p"], x["m"]), lambda z: once(slices(z), joined)))
    return whole


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end): kinds in their order, then by start."""
    parts = []
    for k, kind in enumerate(KINDS):
        item = lambda m, start, end, x, k=k: F.struct(F.lit(k).alias("kind"), start.alias("start"), end.alias("end"))
        hint = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
        parts.append(F.when(hint, _scan(text, PATTERNS[kind], lambda m, kind=kind: _valid(kind, m), item, _SPAN)).otherwise(_nothing(_SPAN)))
    return F.concat(*parts)


def _word(w: Column) -> Column:
    w = F.regexp_replace(F.lower(w), "[0-9]++", "0")
    return F.when(F.char_length(w) > 64, F.concat(F.lit("#"), F.hex(F.xxhash64(w)))).otherwise(w)


def shape(token: Column) -> Column:
    """Runs of letters as one a, runs of digits as one 0."""
    return F.regexp_replace(F.regexp_replace(token, r"[\p{L}]++", "a"), "[0-9]++", "0")


def patterns_of(token: Column, left: Column, right: Column) -> Column:
    """The lexical patterns of a token between two words."""
    kind, key = shape(token), F.regexp_extract(token, r"^([A-Za-z_.-]++)[=:]", 1)
    named = [("L", left), ("R", right), ("B", F.concat_ws(" ", left, right)), ("LS", F.concat_ws(" ", left, kind)), ("RS", F.concat_ws(" ", right, kind))]
    found = F.array(*[F.concat_ws(" ", F.lit(n), c) for n, c in named])
    return F.when(key != "", F.concat(found, F.array(F.concat(F.lit("K "), F.lower(key))))).otherwise(found)


def candidates(text: Column) -> Column:
    """Array of (start, end, token, seed, patterns) of the identifier-like tokens; seed: the kind of a credential."""

    def item(m: Column, start: Column, end: Column, x: Column) -> Column:
        before, after = F.regexp_extract(x["piece"], rf"([^{_WS}]++)[{_WS}]*+$", 1), F.regexp_extract(F.coalesce(x["after"], F.lit("")), rf"^[{_WS}]*+([^{_WS}]++)", 1)
        left = F.when(before != "", before).otherwise(F.coalesce(x["behind"], F.lit("^")))
        right = F.when(after != "", after).otherwise(F.coalesce(x["next"], F.lit("$")))
        seed = F.when(m.rlike(rf"^{SECRET}$"), F.lit(SECRET_KIND))
        return F.struct(start.alias("start"), end.alias("end"), m.alias("token"), seed.alias("seed"), patterns_of(m, _word(left), _word(right)).alias("patterns"))

    return F.when(text.rlike("[0-9@]"), _scan(text, CANDIDATE, lambda m: F.lit(True), item, _TOKEN)).otherwise(_nothing(_TOKEN))


def instance_of(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"^[A-Za-z_.-]++[=:](?=.)", ""))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "secret")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def score_graph(edges: DataFrame, scratch: Scratch, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good patterns (pattern, kind, conf, support), instances (instance, kind, score), and words that introduce other things (pattern).

    ``edges``: pattern, instance, seed (kind or null), n.
    """
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    seeds = edges.filter("seed is not null").groupBy("instance", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    known = scratch.table(seeds)
    patterns = None
    for _ in range(rounds):
        hits = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hit"), F.count_if(F.col("score") >= confidence).alias("support"))
        patterns = scratch.table(hits.join(total, "pattern").select("pattern", "kind", (F.col("hit") / F.col("total")).alias("conf"), "support"))
        good = patterns.filter((F.col("conf") >= confidence) & (F.col("support") >= support))
        reach = edges.join(good, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))))).alias("score"))
        known = scratch.table(seeds.unionByName(reach).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    best = patterns.groupBy("pattern").agg(F.max("conf").alias("conf"))
    words = total.filter((F.col("total") >= support) & F.col("pattern").rlike("^[LR] ")).join(best, "pattern", "left")
    return patterns.filter((F.col("conf") >= confidence) & (F.col("support") >= support)), known, words.filter(F.coalesce("conf", F.lit(0.0)) < 1 - confidence).select("pattern")


def find_pii(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """One row per document: doc_id, base, spans and secrets (arrays of kind, start, end)."""
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    found = scratch.table(lean.select("doc_id", "th", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("tokens")))
    rows = found.select("doc_id", "th", "base", F.explode("tokens").alias("t")).select("doc_id", "th", "base", "t.*")
    over = F.filter("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    seed = F.coalesce(F.get(over, F.lit(0))["kind"], F.col("seed"))
    rows = scratch.table(rows.select("doc_id", "th", "start", "end", instance_of(F.col("token")).alias("instance"), seed.alias("seed"), "patterns"))
    each = rows.select("instance", "seed", F.explode(F.array_distinct("patterns")).alias("pattern"))
    edges = scratch.table(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")))
    good, known, others = score_graph(edges, scratch, confidence=confidence, support=support)
    fresh = rows.filter("seed is null").select("doc_id", "th", "start", "end", "instance", "patterns", F.explode("patterns").alias("pattern"))
    fresh = fresh.join(good.select("pattern", "kind", "conf"), "pattern").join(known.filter(F.col("score") >= confidence), ["instance", "kind"])
    # The best pattern decides if two kinds claim a token.
    token = ["doc_id", "th", "start", "end"]
    best = scratch.table(fresh.groupBy(*token).agg(F.max(F.struct("conf", -F.col("kind"))).alias("b"), F.first("patterns").alias("patterns")).select(*token, "patterns", (-F.col("b.col2")).alias("kind")))
    beside = best.select(*token, "kind", F.explode("patterns").alias("pattern")).join(others.withColumn("other", F.lit(1)), "pattern", "left")
    best = beside.groupBy(*token, "kind").agg(F.count("other").alias("against")).filter("against = 0").drop("against")
    best = best.unionByName(rows.filter(F.col("seed") == SECRET_KIND).select("doc_id", "th", "start", "end", F.col("seed").alias("kind")))
    added = best.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_set(F.struct(F.col("kind").cast("int").alias("kind"), "start", "end")).alias("more"))
    out = found.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    more = F.coalesce("more", _nothing(_SPAN))
    spans = F.concat("base", F.filter(more, lambda s: s["kind"] < SECRET_KIND))
    return out.select("doc_id", "base", F.array_sort(spans).alias("spans"), F.array_sort(F.filter(more, lambda s: s["kind"] == SECRET_KIND)).alias("secrets"))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, all spans as text, and those of credentials apart; n_found: all of them."""
    def of(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
        _joined(F.col("secrets")).alias("secret_spans"), F.size("secrets").cast("long").alias("n_secret"), (F.size("spans") + F.size("secrets")).cast("long").alias("n_found"),
    )

"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base entities (email, ip, card, phone) are found by patterns. They are the seeds: the two words of the whole text before
the word in which a seed starts make a lexical pattern of its kind. Patterns and instances form a graph, which is scored
in rounds: a pattern's confidence is the number of places (words of the corpus) where it stands before an accepted
instance, of all places where it stands before any word; an unseen identifier (a word of LEAST_SIZE code points or more
with an @ or four digits) gets 1 - product of (1 - confidence) over its patterns and is accepted at ACCEPT, for good and
with the kind that scores best then; accepted ones seed the next round, until a round accepts none. A pattern needs
LEAST_SEEDS different instances and the confidence CONFIDENT.

Counts cover the whole corpus. Null and empty texts have no spans. Repeated rows get a row each. Offsets are code points,
ends exclusive. Other columns are ignored; an empty table gives no rows. Very long texts are processed whole. Spans of
different kinds may overlap; ties of a score go to the kind that is last in the alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.common import staged, table

KINDS = ("email", "ip", "card", "phone")
LEAST_SEEDS, CONFIDENT, ACCEPT, LEAST_SIZE = 3, 0.6, 0.6, 5
#: Up to so many patterns (80 bytes each) are broadcast to count them in the texts; above that they are shuffled.
BROADCAST_PATTERNS = 100_000
SHARES = (1, 8, 64)  # bounds of the shares of the texts, of so many by hash, in which patterns are counted
_SPACE = "\\x20\\x09-\\x0D"
#: The base patterns in a form that runs in linear time: possessive where nothing can be given back, and starting only
#: where no longer match could start (or where the last one ended).
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "word": f"(?<![^{_SPACE}])[^{_SPACE}]*[0-9@][^{_SPACE}]*",
}
_NEEDS = {"email": "@", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _found(kind: str) -> Column:
    """Array of (kind, gap, surface, before, within): the code points since the last match, the match, and the runs of
    white space in both."""
    text = F.col("text")
    gaps, hits = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    spaces = lambda x: F.size(F.split(x, f"[{_SPACE}]+", -1)) - 1
    rows = F.zip_with(gaps, hits, lambda g, m: F.struct(F.lit(kind).alias("kind"), F.char_length(g).alias("gap"), m.alias("surface"), spaces(g).alias("before"), spaces(m).alias("within")))
    rows = F.filter(rows, lambda r: r["surface"].isNotNull())
    none = F.array().cast("array<struct<kind:string,gap:int,surface:string,before:int,within:int>>")
    may = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9@]" if kind == "word" else "[0-9]")
    return F.when(may, rows).otherwise(none)


def _replaced(kind: str) -> Column:
    """text with [kind] for each valid match of the kind."""
    text = F.col("text")
    gaps, hits = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    named = lambda m: F.when(m.isNull(), "").when(_valid(F.lit(kind), m), f"[{kind}]").otherwise(m)
    may = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]")
    return F.when(may, F.array_join(F.zip_with(gaps, hits, lambda g, m: F.concat(g, named(m))), "")).otherwise(text)


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    each = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, surface: Column) -> Column:
    """Whether a match of its pattern is an entity of its kind."""
    digits = F.regexp_replace(surface, "[^0-9]", "")
    n = F.length(digits)
    ip = surface.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    card = F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    return F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", n.between(9, 15)).otherwise(True)


def _contexts() -> Column:
    """Array of (word, pattern): the number of each run of white space after which a word starts that may hold the start
    of an instance (it has a digit, @ or +), and the two words before it. White space at the start is a run as well."""

    def of(words: Column) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(w.rlike("[0-9@+]"), i)), lambda i: (i >= 2) & ((i > 2) | (F.get(words, 0) != "")))
        return F.transform(at, lambda i: F.struct(i.alias("word"), F.concat(F.get(words, i - 2), F.lit(" "), F.get(words, i - 1)).alias("pattern")))

    words = F.split(F.lower("text"), f"[{_SPACE}]+", -1)  # an empty word first if white space comes first
    return F.get(F.transform(F.array(words), of), 0)  # split once: the words are a variable of the outer function


def _instances(hits: DataFrame) -> DataFrame:
    """(row, word, kind, start, end, surface, pattern) of the entities and of the words that overlap none (kind word); pattern is
    null where there are not two words before."""
    flat = hits.select("row", F.posexplode("hits").alias("pos", "hit")).select("row", "pos", "hit.*")
    size = F.char_length("surface")
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = flat.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    placed = placed.withColumn("word", (F.sum(F.col("before") + F.col("within")).over(upto) - F.col("within")).cast("int"))
    useful = (F.col("kind") != "word") | ((size >= LEAST_SIZE) & (F.contains(F.col("surface"), F.lit("@")) | (F.length(F.regexp_replace("surface", "[^0-9]", "")) >= 4)))
    placed = placed.where(_valid(F.col("kind"), F.col("surface")) & useful)
    base = F.col("kind") != "word"
    by_start = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    placed = placed.withColumn("reached", reached).withColumn("coming", coming)
    alone = base | ((F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.col("coming").isNull() | (F.col("coming") >= F.col("end"))))
    contexts = hits.select("row", F.inline("contexts"))
    return placed.where(alone).join(contexts, ["row", "word"], "left").select("row", "word", "kind", "start", "end", "surface", "pattern")


def _counted(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, more): occurrences of the patterns in the texts, before whatever word."""
    few = patterns.count() <= BROADCAST_PATTERNS
    names = patterns.select("pattern")
    words = F.filter(F.split(F.lower("text"), f"[{_SPACE}]+"), lambda w: w != "")
    pairs = docs.select(words.alias("w")).where(F.size("w") > 2)
    pairs = pairs.select(F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 2), F.slice("w", 2, F.size("w") - 2), lambda a, b: F.concat(a, F.lit(" "), b))).alias("pattern"))
    if few:
        return pairs.join(F.broadcast(names), "pattern").groupBy("pattern").agg(F.count("*").alias("more"))
    return pairs.groupBy("pattern").agg(F.count("*").alias("more")).join(names, "pattern", "left_semi")  # counted where they are, then shuffled


def _totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total, complete) of the patterns (pattern, n), n the most seeds of a kind that they stand before.

    Every text is counted, in SHARES one after the other. A pattern whose count so far already keeps n below CONFIDENT
    of it cannot recover and takes no part in later shares: its total is a lower bound (not complete).
    """
    share = F.pmod(F.xxhash64("text"), F.lit(SHARES[-1]))
    left = patterns.select("pattern", "n", F.lit(0).cast("long").alias("total"))
    out: DataFrame | None = None
    for low, high in zip((0, *SHARES), SHARES, strict=False):
        more = _counted(docs.where((share >= low) & (share < high)), left)
        now = left.join(more, "pattern", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0))).drop("more")
        now = staged(now.withColumn("open", F.col("n") >= CONFIDENT * (F.col("total") + 1)), "pii")
        last = high == SHARES[-1]
        done = now.select("pattern", "total", F.lit(last).alias("complete")).where(F.lit(last) | ~now["open"])
        out = done if out is None else out.unionByName(done)
        left = now.where("open").drop("open")
    return out


def _discovered(docs: DataFrame, instances: DataFrame) -> DataFrame | None:
    """(kind, surface) of the accepted unseen identifiers, each surface once; None if there are none."""
    seeds = instances.where("kind <> 'word' and pattern is not null").select("kind", "surface", "pattern", "row", "word")
    words = instances.where("kind = 'word' and pattern is not null").select("surface", "pattern", "row", "word")
    accepted: DataFrame | None = None
    totals: DataFrame | None = None
    while True:
        own = seeds if accepted is None else seeds.unionByName(words.join(accepted, "surface").select(*seeds.columns))
        votes = own.groupBy("kind", "pattern").agg(F.count_distinct("surface").alias("different"), F.count_distinct("row", "word").alias("n"))
        votes = staged(votes.where(F.col("different") >= LEAST_SEEDS), "pii")
        names = votes.groupBy("pattern").agg(F.max("n").alias("n"))
        if totals is not None:  # what is not complete and could be confident by the seeds of this round is counted again
            known = names.join(totals, "pattern").where(F.col("complete") | (F.col("n") < CONFIDENT * (F.col("total") + 1)))
            names = names.join(known.select("pattern"), "pattern", "left_anti")
        names = staged(names, "pii")
        if not names.isEmpty():
            more = _totals(docs, names)
            totals = staged(more if totals is None else totals.join(names, "pattern", "left_anti").unionByName(more), "pii")
        if totals is None:
            return accepted
        sure = votes.join(totals, "pattern").withColumn("confidence", F.col("n") / (F.col("total") + 1)).where(F.col("confidence") >= CONFIDENT)
        like = F.when(F.col("kind") == "email", F.contains(F.col("surface"), F.lit("@"))).otherwise(F.length(F.regexp_replace("surface", "[^0-9]", "")) >= 6)
        met = words.join(sure.select("kind", "pattern", "confidence"), "pattern").where(like).select("kind", "surface", "pattern", "confidence").distinct()
        scores = met.groupBy("surface", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        best = scores.groupBy("surface").agg(F.max(F.struct("score", "kind")).alias("best")).where(F.col("best.score") >= ACCEPT)
        fresh = best.select(F.col("best.kind").alias("kind"), "surface")
        if accepted is not None:
            fresh = fresh.join(accepted.select("surface"), "surface", "left_anti").select("kind", "surface")
        fresh = staged(fresh, "pii")
        if fresh.isEmpty():
            return accepted
        accepted = fresh if accepted is None else staged(accepted.unionByName(fresh), "pii")


def _joined(spans: Column) -> Column:
    """kind:start:end of the spans, by start and then by kind as listed."""
    order = F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind_no"] + 1), s["start"], s["end"]))
    return F.array_join(order, ",")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of each row of docs (doc_id, text): arrays of (start, kind_no, end)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hits = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*map(_found, PATTERNS)).alias("hits"), _contexts().alias("contexts"))
    hits = staged(hits, "pii")
    instances = staged(_instances(hits), "pii")
    kind_no = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    span = lambda: F.struct(F.col("start").cast("long").alias("start"), kind_no.alias("kind_no"), F.col("end").cast("long").alias("end"), F.col("base"))
    every = instances.where("kind <> 'word'").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    new = _discovered(docs, instances)
    if new is not None:
        unseen = instances.where("kind = 'word'").select("row", "surface", "start", "end").join(new, "surface")
        every = every.unionByName(unseen.select("row", "kind", "start", "end", F.lit(False).alias("base")))
    spans = every.groupBy("row").agg(F.collect_list(span()).alias("all"))  # the spans of one text
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,base:boolean>>")
    out = hits.select("row", "doc_id").join(spans, "row", "left").withColumn("all", F.coalesce("all", none))
    plain = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end")))
    return out.select("doc_id", plain(F.filter("all", lambda s: s["base"])).alias("base"), plain(F.col("all")).alias("spans"))


def _without(docs: DataFrame, new: DataFrame) -> DataFrame:
    """docs with [kind] for the words in new (kind, surface): whole words between white space, as find() reports them."""
    word = F.filter(F.split("text", f"[{_SPACE}]+"), lambda w: w.rlike("[0-9@]"))
    key = [F.col("doc_id").alias("met_id"), F.xxhash64("text").alias("met_h")]
    names = new.select("surface", F.concat(F.lit("["), "kind", F.lit("]")).alias("name"))
    met = docs.select(*key, F.explode(word).alias("surface")).join(names, "surface").groupBy("met_id", "met_h")
    met = met.agg(F.map_from_entries(F.collect_set(F.struct("surface", "name"))).alias("new"))  # those of one text
    rows = docs.join(met, F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.xxhash64("text") == F.col("met_h")), "left")
    words, gaps = F.split("text", f"[{_SPACE}]+", -1), F.regexp_extract_all("text", F.lit(f"[{_SPACE}]+"), F.lit(0))
    text = F.array_join(F.zip_with(words, gaps, lambda w, g: F.concat(F.coalesce(F.try_element_at("new", w), w), F.coalesce(g, F.lit("")))), "")
    return rows.withColumn("text", F.when(F.col("new").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def masked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, n_chars, ...) with [kind] in place of personal data, n_chars counted again.

    Kind by kind, as listed, each in what the kinds before left; then the words that are accepted unseen identifiers.
    Nothing is shuffled unless unseen identifiers are accepted. Null texts stay null.
    """
    out = docs
    for kind in KINDS:
        out = out.withColumn("text", _replaced(kind))
    hits = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.concat(*map(_found, PATTERNS)).alias("hits"), _contexts().alias("contexts")).where(F.size("hits") > 0), "pii")
    instances = staged(_instances(hits), "pii")
    new = _discovered(docs.where("text is not null"), instances)
    if new is not None:
        out = _without(out, new)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind_no"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))

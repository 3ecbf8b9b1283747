"""Personal data: patterns of known kinds, and bootstrapped contextual extraction, in SQL expressions.

Base spans are the leftmost non-overlapping matches of email, ip, card and phone. SQL has no function
for the places of all matches, so a text is split at a pattern and the lengths of the parts and of
the matches are added up. The patterns are written with possessive repeats and look-behinds, which
match the same strings, so that no text costs more than time in proportion to its length.

The method: base spans are seeds, and the one and the two words before a seed (digits as 0, lower case)
are its lexical patterns. A pattern enters the graph if it has at least SUPPORT distinct seeds and at least
LEAST_SHARE of its places in all texts are seeds. Instances are the seeds and every other token that follows
a pattern of the graph, whatever it is made of; a token of digits goes on over the groups of digits after it,
at most GROUPS of them. On the graph of patterns and instances, ROUNDS times, a pattern's confidence is the
mean score of its instances, and an instance's score is the noisy-or of its patterns' confidences. Tokens
outside base spans with a score of at least ACCEPT under a pattern of at least that confidence are spans of
kind `ctx`.

Spans are code points, end exclusive; of those that begin together the kind listed first comes first. Null
texts count as empty. Equal texts have equal spans; repeated rows each get theirs. Time is in proportion to
a text's length, however many spans it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import free, table
from tessera.session import cut

KINDS = ("email", "ip", "card", "phone", "ctx")
LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = (
    f"(?:(?<![{LOCAL}])|\\G)[{LOCAL}]++@[{HOST}]++(?:\\.[{HOST}]++)++",
    "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "[0-9](?:[\\x20-]?[0-9])++",
    "\\+[0-9][\\x20().0-9-]+[0-9]",
)
#: A sign without which a text can't have the kind.
SIGNS = ("@", None, None, "+")
OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
BLANK = "\\x20\\x09-\\x0D"
WORD, GROUP, CLOSE = f"[^{BLANK}]++", "[(+]?[0-9][0-9().-]*+", "[.,;:!?)\"'\\]]+$"
PER_BLOCK, CHUNK = 128, 2_048
ROUNDS, SUPPORT, LEAST_SHARE, ACCEPT, CONTEXT, GROUPS = 3, 3, 0.1, 0.8, 48, 8
#: Patterns, tokens and spans are broadcast up to so many bytes.
MAX_BYTES = 32 << 20
SPANS = "array<struct<start:int,kind:int,end:int>>"


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once: a lambda's variable stands for it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(items: Column, kind: str, advance, emit) -> Column:
    """The outputs emit(at, item), of type kind, of a fold over items whose state, an int, is advance(at, item).

    First the states at the beginning of blocks, then the blocks for themselves: an array that grows one by
    one, or a state that holds it, would be copied each time.
    """
    none, ints = F.expr(f"cast(array() as array<{kind}>)"), F.expr("cast(array() as array<int>)")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(advance(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out"))

    def run(all_: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_)), F.lit(PER_BLOCK))
        block = lambda i: F.slice(all_, i, F.lit(PER_BLOCK))
        begin = F.struct(F.lit(0).alias("at"), ints.alias("out"))
        states = F.aggregate(firsts, begin, lambda acc, i: F.struct(F.aggregate(block(i), acc["at"], advance).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(firsts, states, lambda i, at: F.aggregate(block(i), F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    return bound(items, run)


def places(text: Column, pattern: str) -> Column:
    """An array of (start, end, found) of all matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)  # one more than found
    pairs = F.filter(F.zip_with(parts, found, lambda a, b: F.struct(F.length(a).alias("lead"), F.length(b).alias("own"), b.alias("found"))), lambda x: x["found"].isNotNull())
    end = lambda at, x: at + x["lead"] + x["own"]
    return folded(pairs, "struct<start:int,end:int,found:string>", end, lambda at, x: F.struct((at + x["lead"]).alias("start"), end(at, x).alias("end"), x["found"].alias("found")))


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK characters: a place in a long text is then found at once."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(pieces: Column, start: Column, length: Column) -> Column:
    first = F.floor(start / CHUNK).cast("int")
    many = F.floor((start + length) / CHUNK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(pieces, first + 1, many), ""), start - first * CHUNK + 1, length)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit doubled, 9 less if over 9."""
    back = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(back, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def passes(kind: int, found: Column) -> Column:
    if kind == 1:
        return F.regexp_like(found, F.lit(f"^{OCTET}(?:\\.{OCTET}){{3}}$"))
    if kind == 2:
        digits = F.translate(found, " -", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == 3:
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def kind_spans(text: Column, pattern: str, kind: int) -> Column:
    kept = F.filter(places(text, pattern), lambda x: passes(kind, x["found"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """A sorted array of (start, kind, end)."""
    out = []
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    for kind, (pattern, sign) in enumerate(zip(PATTERNS, SIGNS, strict=True)):
        may = F.contains(text, F.lit(sign)) if sign else F.regexp_like(text, F.lit("[0-9]"))
        out.append(F.when(may, kind_spans(text, pattern, kind)).otherwise(none))
    return F.array_sort(F.concat(*out))


def seeds(text: Column, spans_: Column) -> Column:
    """The base spans' texts with their lexical patterns: the one and the two words before them."""

    def seed(pieces: Column, s: Column) -> Column:
        lead = piece(pieces, F.greatest(F.lit(0), s["start"] - CONTEXT), F.least(F.lit(CONTEXT), s["start"]))
        plain = F.regexp_replace(F.lower(lead), "[0-9]+", "0")
        two = F.regexp_extract(plain, f"([^{BLANK}]++[{BLANK}]++[^{BLANK}]++)[{BLANK}]*+$", 1)
        return F.struct(
            piece(pieces, s["start"], s["end"] - s["start"]).alias("instance"),
            F.regexp_extract(plain, f"([^{BLANK}]++)[{BLANK}]*+$", 1).alias("one"),
            F.regexp_replace(two, f"[{BLANK}]+", " ").alias("two"),
        )

    none = F.expr("cast(array() as array<struct<instance:string,one:string,two:string>>)")
    return F.when(F.size(spans_) > 0, bound(chunks(text), lambda c: F.transform(spans_, lambda s: seed(c, s)))).otherwise(none)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def fits(df: DataFrame, size: Column) -> bool:
    """Whether the rows are small enough to broadcast, by the bytes that they hold."""
    return (df.agg(F.sum(size + 48)).first()[0] or 0) <= MAX_BYTES


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_, digest_, spans_, seeds_) of every row, cut off from the texts."""
    rows = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    rows = rows.withColumn("spans_", base_spans(F.col("text_")))
    return cut(rows.select("id_", digest(F.col("text_")).alias("digest_"), "spans_", seeds(F.col("text_"), F.col("spans_")).alias("seeds_")))


def supported(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, instance) of the seeds, and (pattern, hits) of patterns with SUPPORT distinct seeds; hits are their places."""
    each = found.select(F.explode("seeds_").alias("s"))
    pairs = each.select(F.explode(F.array(F.concat(F.lit("1 "), "s.one"), F.concat(F.lit("2 "), "s.two"))).alias("pattern"), "s.instance").filter(F.length("pattern") > 2)
    own = cut(pairs.groupBy("pattern", "instance").agg(F.count("*").alias("n")))
    enough = own.groupBy("pattern").agg(F.count("*").alias("seeds"), F.sum("n").alias("hits")).filter(F.col("seeds") >= SUPPORT)
    return own.select("pattern", "instance"), cut(enough.select("pattern", "hits"))


def followed(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(digest_, pos, pattern): the words, by number from 0, that are followed by another and end a wanted pattern."""
    few = fits(wanted, F.length("pattern"))
    side = F.broadcast if few else (lambda df: df)
    again = lambda c: F.concat(F.col(c), F.lit("")).alias(c)
    last = wanted.select(F.substring_index("pattern", " ", -1).alias("word")).distinct()
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"^[{BLANK}]+", "")
    plain = F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), f"[{BLANK}]+")
    each = docs.select(digest(F.col(text_col)).alias("digest_"), plain.alias("plain_")).select("digest_", "plain_", F.posexplode("plain_").alias("pos", "word"))
    each = each.filter((F.col("pos") + 1 < F.size("plain_")) & (F.get("plain_", F.col("pos") + 1) != ""))
    each = each.select("digest_", "pos", "word", F.when(F.col("pos") > 0, F.expr("element_at(plain_, pos)")).alias("before"))
    ends = each.join(side(last.select(again("word"))), "word")
    two = F.concat(F.lit("2 "), "before", F.lit(" "), "word")
    both = ends.select("digest_", "pos", F.explode(F.array(F.concat(F.lit("1 "), "word"), two)).alias("pattern"))
    return both.join(side(wanted.select(again("pattern"))), "pattern").select("digest_", "pos", "pattern")


def tokens(docs: DataFrame, text_col: str, found: DataFrame, graph: DataFrame) -> DataFrame:
    """(digest_, start, end, instance, pattern) of the tokens outside base spans that follow a pattern."""
    at = cut(followed(docs, text_col, graph).distinct()).groupBy("digest_").agg(F.collect_list(F.struct("pos", "pattern")).alias("at_"))
    few = fits(at, F.size("at_") * 40)
    again = docs.select(digest(F.col(text_col)).alias("digest_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    again = again.join(F.broadcast(at) if few else at.select(F.concat("digest_", F.lit(b"")).alias("digest_"), "at_"), "digest_")

    def token(words: Column, x: Column) -> Column:
        own = F.get(words, x["pos"] + 1)
        rest = F.transform(F.sequence(F.lit(2), F.lit(1 + GROUPS)), lambda k: F.get(words, x["pos"] + k))  # a slice copies all words
        group = lambda w: F.coalesce(F.regexp_like(w["found"], F.lit(f"^{GROUP}[.,;:!?)]*+$")), F.lit(False))
        stop = F.aggregate(rest, F.struct(F.lit(True).alias("on"), own["end"].alias("end"), own["found"].alias("text")), lambda acc, w: F.struct(
            (acc["on"] & group(w)).alias("on"), F.when(acc["on"] & group(w), w["end"]).otherwise(acc["end"]).alias("end"),
            F.when(acc["on"] & group(w), F.concat(acc["text"], F.lit(" "), w["found"])).otherwise(acc["text"]).alias("text")))
        whole = F.when(group(own), stop).otherwise(F.struct(F.lit(False).alias("on"), own["end"].alias("end"), own["found"].alias("text")))
        return bound(whole, lambda t: bound(F.regexp_replace(t["text"], CLOSE, ""), lambda bare: F.struct(
            own["start"].alias("start"), (t["end"] - F.length(t["text"]) + F.length(bare)).alias("end"), bare.alias("instance"), x["pattern"].alias("pattern"))))

    each = again.select("digest_", F.explode(bound(places(F.col("text_"), WORD), lambda words: F.transform("at_", lambda x: token(words, x)))).alias("t"))
    each = each.select("digest_", "t.*").filter(F.length("instance") > 0).distinct()
    # a token is free if no span that begins before it reaches into it and none begins inside
    taken = found.select("digest_", F.explode("spans_").alias("s")).select("digest_", "s.start", "s.end").distinct()
    nothing = F.lit(None).cast("string")
    every = each.withColumn("kind", F.lit(1)).unionByName(taken.select("digest_", "start", "end", nothing.alias("instance"), nothing.alias("pattern"), F.lit(0).alias("kind")))
    order = Window.partitionBy("digest_").orderBy("start", "kind")
    span = lambda c: F.when(F.col("kind") == 0, F.col(c))
    reach = F.max(span("end")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("digest_").orderBy(F.desc("start"), F.desc("kind"))  # a frame to the end would be added up anew at each row
    ahead = F.min(span("start")).over(back.rowsBetween(Window.unboundedPreceding, -1))
    marks = every.withColumn("reach", reach).withColumn("ahead", ahead).filter(F.col("kind") == 1)
    free_ = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))
    return cut(marks.filter(free_).select("digest_", "start", "end", "instance", "pattern"))


def confident(edges: DataFrame) -> DataFrame:
    """(pattern, instance) pairs that the bootstrap accepts, of edges (pattern, instance, seed)."""
    edges = cut(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(ROUNDS):
        scores = scores.select(F.concat("instance", F.lit("")).alias("instance"), "score")
        seen = edges.join(scores, "instance")
        patterns = cut(seen.groupBy("pattern").agg(F.avg("score").alias("confidence")))
        told = edges.join(patterns.select(F.concat("pattern", F.lit("")).alias("pattern"), "confidence"), "pattern")
        miss = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        scores = cut(told.groupBy("instance").agg(F.when(F.max("seed"), 1.0).otherwise(1 - miss).alias("score")))
    strong = patterns.filter(F.col("confidence") >= ACCEPT).select(F.concat("pattern", F.lit("")).alias("pattern"))
    likely = scores.filter(F.col("score") >= ACCEPT).select(F.concat("instance", F.lit("")).alias("instance"))
    return edges.filter(~F.col("seed")).join(strong, "pattern").join(likely, "instance").select("pattern", "instance")


def discovered(docs: DataFrame, text_col: str, found: DataFrame) -> DataFrame:
    """(digest_, new_): by digest of a text the spans that the bootstrap adds to it."""
    own, patterns = supported(found)
    total = followed(docs, text_col, patterns).groupBy("pattern").agg(F.count("*").alias("total"))
    share = F.col("hits") / F.greatest("hits", F.coalesce("total", F.lit(0)))
    graph = cut(patterns.join(total.select(F.concat("pattern", F.lit("")).alias("pattern"), "total"), "pattern", "left").filter(share >= LEAST_SHARE).select("pattern"))
    seen = tokens(docs, text_col, found, graph)
    seeded = own.join(graph, "pattern", "left_semi").withColumn("seed", F.lit(True))
    good = cut(confident(seeded.unionByName(seen.select("pattern", "instance", F.lit(False).alias("seed")))))
    new = seen.join(good, ["pattern", "instance"]).groupBy("digest_").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("new_"))
    return cut(new.select("digest_", F.array_sort("new_").alias("new_")))


def with_new(rows: DataFrame, new: DataFrame, key: str, as_: str) -> DataFrame:
    """The rows with the spans of their digest in the column as_; all rows stay."""
    few = fits(new, F.size("new_") * 12 + 16)
    new = new.select(F.concat("digest_", F.lit(b"")).alias("other_digest_"), F.col("new_").alias(as_))
    joined_ = rows.join(F.broadcast(new) if few else new, rows[key] == F.col("other_digest_"), "left").drop("other_digest_")
    return joined_.withColumn(as_, F.coalesce(as_, F.expr(f"cast(array() as {SPANS})")))


def joined(spans_: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts, base_sha256, spans and n_ctx of every whole text."""
    found = marked(docs, id_col, text_col)
    got = with_new(found, discovered(docs, text_col, found), "digest_", "new_").withColumn("all_", F.array_sort(F.concat("spans_", "new_")))
    count = lambda k: F.size(F.filter("spans_", lambda s: s["kind"] == k)).cast("bigint")
    return got.select(F.col("id_").alias(id_col), *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(joined(F.col("spans_")), 256).alias("base_sha256"), joined(F.col("all_")).alias("spans"), F.size("new_").cast("bigint").alias("n_ctx"))


def masked(text: Column, spans_: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are one, of the first's kind."""
    name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def whole(pieces: Column) -> Column:
        def shown(at: Column, s: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(piece(pieces, at, s["start"] - at), F.element_at(name, s["kind"] + 1))).otherwise("")

        end = F.array_max(F.transform(spans_, lambda s: s["end"]))
        parts = folded(spans_, "string", lambda at, s: F.greatest(at, s["end"]), shown)
        return F.concat(F.array_join(parts, ""), piece(pieces, end, F.length(text) - end))

    return bound(chunks(text), whole)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with personal data masked in the text; all rows and columns kept, null texts stay null.

    Base spans are found anew in each row's text; only spans of the bootstrap are joined to it, by digest
    of the text, and broadcast while they are of at most MAX_BYTES.
    """
    found = marked(docs, id_col, text_col)
    new_, spans_, mine = (free(n, docs.columns) for n in ("new_", "spans_", "digest_"))
    rows = docs.withColumn(mine, digest(F.col(text_col)))
    back = with_new(rows, discovered(docs, text_col, found), mine, new_)
    back = back.withColumn(spans_, F.array_sort(F.concat(base_spans(F.col(text_col)), F.col(new_))))
    text = F.when(F.size(spans_) > 0, masked(F.col(text_col), F.col(spans_))).otherwise(F.col(text_col))
    return back.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return find(table(spark, sf_dir, "documents"))

"""Personal data by fixed patterns and by bootstrapped contextual extraction.

Emails, IP addresses, card and phone numbers of fixed form are found in every text. These seed
entities are instances whose contexts, the two words before them, become lexical patterns. Other
identifier-like tokens (with a digit or @) after the same contexts are candidate instances. Patterns
and instances form a graph that is scored in rounds:

* a context's confidence is the sum of its trusted instances' scores over the number of times it
  occurs in the corpus before any word at all, plus one, so that common words never become patterns
  however often an entity follows them; it is a pattern in the rounds where its confidence is at
  least ``CONFIDENCE`` and it precedes at least ``SUPPORT`` different trusted instances;
* an instance's score is 1 for a seed and else 1 - prod(1 - confidence) over the patterns it follows;
  it is trusted once it follows one.

Trusted instances induce patterns of their own in the next round, which discover further ones. Scores
only rise; rounds end when none has moved by a hundredth. What is trusted then is added as spans of kind
``identifier``.

Matching runs on the texts once; candidate contexts, those that enough identifier-like tokens follow, are
counted in one more pass, in which they are broadcast below a checked size and shuffled beyond it. The graph
holds a row per identifier-like token, and hot contexts or values are summed before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.common import Scratch, let, words

CONFIDENCE = 0.5
SUPPORT = 3
CONTEXT_WORDS = 2
#: Contexts up to which they are broadcast (8 bytes each).
BROADCAST_CONTEXTS = 2_000_000

KINDS = ["email", "ip", "card", "phone"]

# The contract's expressions. What cannot begin a leftmost match is skipped by looking back, and
# repetitions that never give back are possessive, so that long runs cost linear time and no stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

_SPANS = "array<struct<start:int,end:int,value:string,lead:string>>"


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their code-point positions, end exclusive.

    ``lead`` is what stands before a match, from the match before the last one on. Positions are sums
    of lengths, kept per block of about sqrt(n) matches, so that n matches cost n * sqrt(n) steps.
    """

    def spans(p: Column) -> Column:
        gaps, hits = p["gaps"], p["hits"]
        block = F.ceil(F.sqrt(F.size(hits) + 1)).cast("int")
        lengths = F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))

        def before(sizes: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(
                F.sequence(F.lit(0), F.floor(F.size(hits) / block).cast("int")),
                zero,
                lambda acc, b: F.struct(
                    (acc["at"] + _sum(F.slice(sizes, b * block + 1, block))).alias("at"),
                    F.array_append(acc["out"], acc["at"]).alias("out"),
                ),
                lambda acc: acc["out"],
            )

        def placed(known: Column) -> Column:
            def span(hit: Column, i: Column) -> Column:
                first = i - i % block
                start = F.get(known["before"], F.floor(i / block).cast("int")) + _sum(F.slice(known["sizes"], first + 1, i % block)) + F.length(F.get(gaps, i))
                around = [x for j in range(CONTEXT_WORDS, 0, -1) for x in (F.get(hits, i - j), F.get(gaps, i - j + 1))]
                lead = F.concat_ws("", *around)
                return let(start, lambda at: F.struct(at.alias("start"), (at + F.length(hit)).alias("end"), hit.alias("value"), lead.alias("lead")))

            return F.transform(hits, span)

        return let(lengths, lambda sizes: let(F.struct(sizes.alias("sizes"), before(sizes).alias("before")), placed))

    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(gaps.alias("gaps"), hits.alias("hits")), spans)


def _only_if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans of each fixed kind in a text that is not null."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    long_digits = text.rlike("[0-9][\\x20-]?[0-9]")
    dotted = text.rlike(r"[0-9]\.[0-9]")

    def ip_ok(s: Column) -> Column:
        # A part has at most three digits once leading zeros are gone, so the cast cannot overflow.
        parts = F.transform(F.split(s["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))

    def card_ok(s: Column) -> Column:
        n = F.length(digits(s))
        return (n >= 16) & (n <= 19) & F.call_function("luhn_check", digits(s))

    def phone_ok(s: Column) -> Column:
        n = F.length(digits(s))
        return (n >= 8) & (n <= 15)

    return {
        "email": _only_if(F.contains(text, F.lit("@")), located(text, EMAIL)),
        "ip": F.filter(_only_if(dotted, located(text, IP)), ip_ok),
        "card": F.filter(_only_if(long_digits, located(text, CARD)), card_ok),
        "phone": F.filter(_only_if(F.contains(text, F.lit("+")), located(text, PHONE)), phone_ok),
    }


def _context(before: list[Column]) -> Column:
    """Hash of words in lower case, digits alike."""
    return F.xxhash64(*[F.regexp_replace(F.lower(w), "[0-9]", "0") for w in before])


def _last_words(lead: Column) -> Column:
    """The context that ends a lead, null if it has too few words."""
    near = words(lead)
    own = range(-CONTEXT_WORDS, 0)
    return let(near, lambda w: F.when(F.size(w) >= CONTEXT_WORDS, _context([F.element_at(w, i) for i in own])))


def _marked(docs: DataFrame) -> DataFrame:
    """Base spans and identifier-like tokens of each document, with a key of the document's row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))
    found = rows.select("doc_id", "mark", "text", *[F.transform(s, lambda x: F.struct(x["start"], x["end"])).alias(k) for k, s in base_spans(F.col("text")).items()])
    tokens = _only_if(F.col("text").rlike("[0-9@]"), located(F.col("text"), TOKEN))
    trimmed = r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$"

    def described(t: Column) -> Column:
        body = F.regexp_replace(t["value"], trimmed, "")
        lead = F.length(t["value"]) - F.length(F.regexp_replace(t["value"], r"^[\p{P}\p{S}]+", ""))
        start = t["start"] + lead
        kinds = [
            F.when(F.exists(k, lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"])), k) for k in KINDS
        ]
        return F.struct(
            start.alias("start"),
            (start + F.length(body)).alias("end"),
            F.xxhash64(body).alias("value"),
            _last_words(t["lead"]).alias("context"),
            F.coalesce(*kinds).alias("kind"),
        )

    return found.withColumn("tokens", F.transform(tokens, described)).drop("text")


def _with_occurrences(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Number of places in the corpus where each context occurs before a word."""
    word = words(F.col("text"))
    plain = F.transform(word, lambda w: F.regexp_replace(F.lower(w), "[0-9]", "0"))
    places = F.size("w") - CONTEXT_WORDS
    runs = F.arrays_zip(*[F.slice("w", i + 1, places).alias(f"w{i}") for i in range(CONTEXT_WORDS)])
    placed = docs.select(plain.alias("w")).filter(F.size("w") > CONTEXT_WORDS).select(F.explode(runs).alias("p"))
    placed = placed.select(F.xxhash64(*[f"p.w{i}" for i in range(CONTEXT_WORDS)]).alias("context"))
    if contexts.count() <= BROADCAST_CONTEXTS:
        return placed.join(F.broadcast(contexts), "context").groupBy("context").agg(F.count("*").alias("occurs"))
    # Counted before the join, which then sees each context once.
    return placed.groupBy("context").agg(F.count("*").alias("occurs")).join(contexts, "context")


def identifiers(docs: DataFrame, marked: DataFrame, scratch: Scratch) -> DataFrame:
    """Added identifier spans: doc_id, mark, start, end, context and score."""
    seen = scratch.keep(
        marked.select("doc_id", "mark", F.explode("tokens").alias("t")).select("doc_id", "mark", "t.*").filter("context is not null and end > start"),
        "tokens",
    )
    # How often each value follows each context; seeds are certain wherever they occur.
    follows = seen.groupBy("context", "value").agg(F.count("*").alias("n"), F.max(F.col("kind").isNotNull().cast("int")).alias("seed"))
    follows = scratch.keep(follows, "follows")
    followed = follows.groupBy("context").agg(F.count("*").alias("support"), F.sum("n").alias("most")).filter(F.col("support") >= SUPPORT)
    followed = scratch.keep(followed.select("context", "most"), "followed")
    # Even with every follower trusted, the others stay below the confidence.
    counted = _with_occurrences(docs, followed.select("context")).join(followed, "context")
    counted = scratch.keep(counted.filter(F.col("most") >= CONFIDENCE * (F.col("occurs") + 1)).select("context", "occurs"), "occurrences")
    graph = scratch.keep(follows.join(counted, "context"), "graph")
    seeds = follows.groupBy("value").agg(F.max("seed").alias("seed")).filter("seed = 1").select("value")
    seeds = scratch.keep(seeds.join(graph.select("value").distinct(), "value", "left_semi"), "seeds")
    scored = scratch.keep(seeds.select("value", F.lit(1.0).alias("score")), "scores")
    before = None
    while True:
        mark = scored.agg(F.count("*").alias("n"), F.sum(F.round(F.col("score") * 100).cast("long")).alias("total")).first()
        if mark == before:
            break
        before = mark
        patterns = (
            graph.join(scored, "value")
            .groupBy("context", "occurs")
            .agg(F.count("*").alias("support"), F.sum(F.col("n") * F.col("score")).alias("mass"))
            .select("context", "support", F.least(F.col("mass") / (F.col("occurs") + 1), F.lit(0.999)).alias("confidence"))
            .filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
        )
        patterns = scratch.keep(patterns, "patterns")
        found = graph.join(patterns, "context").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        both = found.unionByName(seeds.select("value", F.lit(1.0).alias("score")))
        after = scratch.keep(both.groupBy("value").agg(F.max("score").alias("score")), "scores")
        scratch.drop(scored)
        scored = after
    pairs = graph.join(patterns, "context", "left_semi").join(scored, "value").select("context", "value", "score")
    return seen.filter("kind is null").join(pairs, ["context", "value"]).select("doc_id", "mark", "start", "end", "context", "score")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of every document: doc_id, counts of the base kinds, base_sha256 and all spans.

    ``spans`` lists ``kind:start:end`` by kind (email, ip, card, phone, identifier) and start;
    positions count code points and ends are exclusive. Null and empty texts have no spans, and the
    digest of the empty string. Very long texts are read whole, in one row of a task. Repeated rows and null doc_ids each keep their row. Other columns,
    whatever their names, are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    marked = scratch.keep(_marked(docs), "marked")
    added = (
        identifiers(docs, marked, scratch)
        .groupBy("doc_id", "mark")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("identifier"))
    )
    a, b = marked.alias("a"), added.alias("b")
    joined = a.join(b, F.col("a.mark").eqNullSafe(F.col("b.mark")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left")

    def listed(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    base = F.concat(*[listed(k, F.col(f"a.{k}")) for k in KINDS])
    found = F.coalesce(listed("identifier", F.col("b.identifier")), F.array().cast("array<string>"))
    return joined.select(
        F.col("a.doc_id"),
        *[F.size(f"a.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, found), ",").alias("spans"),
    )

"""Personal data by bootstrapped contextual extraction (native).

Base patterns (email, ip, card, phone) with their checks give the seeds. The words around a seed, one and
two to the left, one and two to the right, and one on both sides, are its lexical patterns; so is its
own make-up (digits, letters, marks, and which checks hold) beside a kind of neighbour. Everything else that looks like an
identifier is an instance under the patterns around it: a word with an at sign or six to MOST digits, and several such words in a row.
In a row of more than FEW, longer runs count from its first word or up to its last, where a context stands beside them.

On the graph of patterns and distinct instances, Spark scores in turns: a pattern for a kind by the share of its
instances that are known to be of that kind, an instance by the chance that not all of its patterns are wrong.
Instances that reach MIN_SCORE, with a pattern of that score and MIN_SEEDS known instances behind it, are known from
then on, with the kind of the pattern, whatever they look like: a number without its plus, an address without a dot, a
card with a mistyped digit, or one that the base pattern lost in a run of digits. Rounds go on until nothing new is
known, so there is no bound on them: each adds to a finite set. Instances that overlap an earlier one in their text are left out.

Texts are read once; what is found is written as arrays per row, and only patterns and instances are
shuffled, as counts of distinct ones, so frequent words and repeated texts are added up before they
meet. Every regular expression starts at a boundary and is possessive, so long texts take linear time.

Defined results: null and empty texts have no spans; repeated rows get a row each with the same spans;
an empty table gives no rows; extra columns are ignored. Spans count code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .words import whole

KINDS = ("email", "ip", "card", "phone")
#: The same leftmost matches as the plain patterns, without retries inside a run that failed.
#: A card's run is matched at the lengths that can be valid only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word with a digit or an at sign.
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*+"
#: What a text must have for a pattern to be worth trying.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "word": "[0-9@]"}
#: Words of a run wherever it stands.
FEW = 4
#: Digits of the longest identifier; each word of a run has one at least, so also its words.
MOST = 19
#: Least share of known instances for a pattern to count at all.
WEAK = 0.5
BLOCK = 256
MIN_SCORE = 0.8
MIN_SEEDS = 3
#: left and right: the text between neighbouring matches; a mark stands for these and for the ends of the text. gap: what follows is one blank and another match.
SPAN = "struct<start:int,end:int,text:string,left:string,right:string,gap:boolean>"
GAP = r"[\x20\x09-\x0D|]"


def _located(pieces: str, found: str) -> Column:
    """Spans of the matches `found`, between the `pieces` of the same split.

    Positions are running sums. They are kept in blocks of BLOCK spans, so that appending to an array copies no
    more than a block, whatever the number of matches. Contexts keep the four pieces next to a match that blanks set off.
    """
    span = """named_struct('start', a.at + char_length(x.p), 'end', a.at + char_length(x.p) + char_length(x.m), 'text', x.m, 'left', substring_index(concat(x.before, x.p), ' ', -4), 'right', substring_index(concat(x.q, x.after), ' ', 4), 'gap', x.q = ' ' and x.after = ' #')"""
    block = f"""aggregate(block, named_struct('at', s.at, 'out', cast(array() as array<{SPAN}>)),
        (a, x) -> named_struct('at', a.at + char_length(x.p) + char_length(x.m), 'out', concat(a.out, array({span}))))"""
    around = f"""zip_with(slice({pieces}, 1, size({found})), slice({pieces}, 2, size({found})), (p, q) -> named_struct('p', p, 'q', q))"""
    matched = f"""transform(zip_with({around}, {found}, (r, m) -> named_struct('p', r.p, 'q', r.q, 'm', m)), (r, i) ->
        named_struct('p', r.p, 'q', r.q, 'm', r.m, 'before', if(i = 0, '^ ', '# '), 'after', if(i = size({found}) - 1, ' $', ' #')))"""
    return F.expr(f"""
        transform(array({matched}), z ->
            aggregate(transform(sequence(0, greatest(size(z) - 1, 0) div {BLOCK}), b -> slice(z, int(b) * {BLOCK} + 1, {BLOCK})),
                named_struct('at', 0, 'out', cast(array() as array<array<{SPAN}>>)),
                (s, block) -> transform(array({block}), r -> named_struct('at', r.at, 'out', concat(s.out, array(r.out))))[0],
                s -> flatten(s.out)))[0]""")


def _valid(kind: str, text: Column) -> Column:
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return digits.between(13, 19) & F.call_function("luhn_check", F.regexp_replace(text, "[ -]", ""))
    return digits.between(9, 15) if kind == "phone" else F.lit(True)


def _context(text: Column, adjoining: str) -> Column:
    """Lower-cased words of a context, without what adjoins the match; those with a digit or an at sign as #."""
    words = F.array_remove(F.split(F.lower(F.regexp_replace(text, adjoining, "")), GAP + "+"), "")
    return F.transform(words, lambda w: F.when(w.rlike("[0-9@]"), "#").otherwise(w))


def _make_up(text: Column) -> Column:
    """Digits as 9, letters as a, and the kinds whose checks hold."""
    shape = F.regexp_replace(F.regexp_replace(text, "[A-Za-z]+", "a"), "[0-9]", "9")
    digits = F.regexp_replace(text, "[^0-9]", "")
    card = text.rlike(r"^[0-9](?:[\x20-]?[0-9]){12,18}$") & F.call_function("luhn_check", digits)
    ip = text.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & F.forall(F.split(text, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    return F.when(card, F.lit("card")).when(ip, F.lit("ip")).otherwise(shape)


def _patterns(text: Column, left: Column, right: Column, make_up: bool) -> Column:
    """Distinct patterns around an instance, of its own make-up too if wanted. left, right: arrays of words, columns and not expressions."""
    a, b = F.element_at(left, -1), right[0]
    a2, b2 = F.when(F.size(left) > 1, F.element_at(left, -2)), F.when(F.size(right) > 1, right[1])
    kind = lambda w: F.when(w.isin("#", "^", "$"), w).otherwise("w")
    # a mark alone says too little
    word = lambda w: F.when(~w.isin("#", "^", "$"), w)
    own = [F.concat(F.lit("ml "), kind(a), F.lit(" "), _make_up(text)), F.concat(F.lit("mr "), _make_up(text), F.lit(" "), kind(b))] if make_up else []
    return F.array_distinct(F.array_compact(F.array(
        F.concat(F.lit("l1 "), word(a)), F.concat(F.lit("l2 "), a2, F.lit(" "), a), F.concat(F.lit("r1 "), word(b)), F.concat(F.lit("r2 "), b, F.lit(" "), b2),
        F.concat(F.lit("lr "), word(a), F.lit(" "), word(b)), *own)))


def _runs(words: str) -> Column:
    """The spans of `words`, and of several in a row that single blanks set off: up to FEW of them, and up to MOST where the run stands at an end of its row."""
    gaps, more = f"transform({words}, w -> w.gap)", MOST - 1
    ahead = f"slice(gaps, i + 1, {more})"
    reach = f"if(array_position({ahead}, false) = 0, size({ahead}), int(array_position({ahead}, false)) - 1)"
    run = f"named_struct('start', w.start, 'end', {words}[i + d].end, 'text', array_join(slice(texts, i + 1, d + 1), ' '), 'left', w.left, 'right', {words}[i + d].right, 'gap', {words}[i + d].gap)"
    wanted = f"filter(sequence(0, {reach}), d -> d < {FEW} or i = 0 or not gaps[i - 1] or not gaps[i + d])"
    return F.expr(f"flatten(transform(array({gaps}), gaps -> flatten(transform(array(transform({words}, w -> w.text)), texts -> flatten(transform({words}, (w, i) -> if(gaps[i], transform({wanted}, d -> {run}), array(w))))))))")


def _free(runs: str, base: str) -> Column:
    """The runs that overlap no span of base. Both are put in one order, starts of base and ends of runs; a run is free if no span that
    began before its end ends after its start. One pass, in blocks as in _located."""
    events = f"""array_sort(concat(transform({base}, b -> named_struct('at', b.start, 'kind', 1, 'i', 0, 'x', b.end)), transform(sorted, (r, i) -> named_struct('at', r.e, 'kind', 0, 'i', i, 'x', r.w.start))))"""
    block = """aggregate(block, named_struct('m', s.m, 'out', cast(array() as array<boolean>)),
        (a, v) -> named_struct('m', if(v.kind = 1, greatest(a.m, v.x), a.m), 'out', if(v.kind = 1, a.out, concat(a.out, array(a.m <= v.x)))))"""
    flags = f"""transform(array({events}), z -> aggregate(transform(sequence(0, greatest(size(z) - 1, 0) div {BLOCK}), k -> slice(z, int(k) * {BLOCK} + 1, {BLOCK})),
        named_struct('m', 0, 'out', cast(array() as array<array<boolean>>)),
        (s, block) -> transform(array({block}), r -> named_struct('m', r.m, 'out', concat(s.out, array(r.out))))[0], s -> flatten(s.out)))[0]"""
    return F.expr(f"""transform(array(array_sort(transform({runs}, w -> named_struct('e', w.end, 'w', w)))), sorted ->
        transform(filter(zip_with(sorted, {flags}, (r, f) -> named_struct('w', r.w, 'f', f)), y -> y.f), y -> y.w))[0]""")


def found(docs: DataFrame, hidden: Callable[[Column], Column] | None = None) -> DataFrame:
    """row, doc_id, base array<struct<k,kind,start,end,text,left,right>> (checked), others array<SPAN> (words that overlap none of base).

    hidden: which texts of base spans to leave out, to measure how many of them are found again.
    """
    t = F.col("_t")
    nothing = F.array().cast("array<string>")
    at = docs.select("doc_id", whole("text").alias("_t"))
    for kind, pattern in [*PATTERNS.items(), ("word", WORD)]:
        needed = t.contains("@") if NEEDS[kind] == "@" else t.rlike(NEEDS[kind])
        at = at.withColumn(f"_m_{kind}", F.when(needed, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(nothing))
    for kind, pattern in [*PATTERNS.items(), ("word", WORD)]:
        at = at.withColumn(f"_p_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split(t, pattern, -1)).otherwise(nothing))
    base = [_checked(k, kind) for k, kind in enumerate(KINDS)]
    all_base = F.concat(*base)
    at = at.select("doc_id", (F.filter(all_base, lambda s: ~hidden(s["text"])) if hidden else all_base).alias("base"), _located("_p_word", "_m_word").alias("words"))
    # without the marks around them, if they have an at sign or six digits
    digits = lambda s: F.length(F.regexp_replace(s["text"], "[^0-9]", ""))
    runs = F.when(F.size("words") > 0, F.filter(F.transform(_runs("words"), _trimmed), lambda s: s["text"].contains("@") | digits(s).between(6, MOST))).otherwise(F.col("words"))
    at = at.select("doc_id", "base", runs.alias("runs"))
    free = F.when((F.size("runs") > 0) & (F.size("base") > 0), _free("runs", "base")).otherwise(F.col("runs"))
    return at.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", free.alias("others"))


def _checked(k: int, kind: str) -> Column:
    spans = F.filter(_located(f"_p_{kind}", f"_m_{kind}"), lambda s: _valid(kind, s["text"]))
    return F.transform(spans, lambda s: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["left"].alias("left"), s["right"].alias("right")))


def _trimmed(span: Column) -> Column:
    lead = F.char_length(F.regexp_extract(span["text"], "^[^A-Za-z0-9+(]*", 0))
    core = F.regexp_extract(span["text"], "^[^A-Za-z0-9+(]*+(.*?)[^A-Za-z0-9]*$", 1)
    return F.struct((span["start"] + lead).alias("start"), (span["start"] + lead + F.char_length(core)).alias("end"), core.alias("text"), span["left"].alias("left"), span["right"].alias("right"), span["gap"].alias("gap"))


def _edges(seen: DataFrame, make_up: bool) -> DataFrame:
    """Distinct pattern, text of (text, left, right)."""
    words = seen.select("text", _context(F.col("left"), r"(?<![^\x20\x09-\x0D|])[^\x20\x09-\x0D|]++$").alias("l"), _context(F.col("right"), r"^[^\x20\x09-\x0D|]++").alias("r"))
    return words.select(F.explode(_patterns(F.col("text"), F.col("l"), F.col("r"), make_up)).alias("pattern"), "text").distinct()


def known(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """text, kind of everything that is known in the end, from edges (pattern, text) and seeds (text, kind): seeds and the instances that patterns vouch for."""
    so_far = seeds
    while True:
        # runs that aren't known and share the word next to the pattern are one instance of it
        beside = F.when(F.col("pattern").rlike("^m?l "), F.substring_index("text", " ", 1)).otherwise(F.substring_index("text", " ", -1))
        labelled = edges.join(so_far, "text", "left").groupBy("pattern", F.when(F.col("kind").isNull(), beside).otherwise(F.col("text")).alias("instance")).agg(F.max("kind").alias("kind"))
        counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
        per = labelled.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *counts)
        kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("known")) for k in KINDS])
        scored = per.select("pattern", "n", F.inline(kinds)).where(F.col("known") >= MIN_SEEDS).select("pattern", "kind", (F.col("known") / F.col("n")).alias("c"))
        patterns = written(scored.where(F.col("c") >= WEAK), "patterns")
        doubt = F.exp(F.sum(F.log1p(-F.least("c", F.lit(0.999)))))
        open_ = edges.join(so_far.select("text"), "text", "left_anti").join(patterns, "pattern")
        sure = open_.groupBy("text", "kind").agg((1 - doubt).alias("score"), F.max("c").alias("best")).where((F.col("score") >= MIN_SCORE) & (F.col("best") >= MIN_SCORE))
        new = written(sure.groupBy("text").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")), "known")
        if new.isEmpty():
            return so_far
        so_far = written(so_far.unionByName(new), "known")


def extracted(docs: DataFrame, hidden: Callable[[Column], Column] | None = None, make_up: bool = True) -> DataFrame:
    """doc_id, base and added (arrays of spans k, kind, start, end) for every row of docs. make_up=False: by contexts alone."""
    rows = written(found(docs, hidden), "found")
    seeds = rows.select(F.explode("base").alias("b")).select("b.k", "b.kind", "b.text", "b.left", "b.right")
    others = rows.where(F.size("others") > 0).select("row", F.explode("others").alias("o")).select("row", "o.start", "o.end", "o.text", "o.left", "o.right")
    edges = written(_edges(seeds.select("text", "left", "right").unionByName(others.select("text", "left", "right")).distinct(), make_up), "graph")
    seed_kinds = written(seeds.groupBy("text").agg(F.min_by("kind", "k").alias("kind")), "seeds")
    accepted = written(known(edges, seed_kinds), "accepted")
    at = others.select("row", "start", "end", "text").join(accepted, "text")
    earlier = F.max("end").over(Window.partitionBy("row").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1))
    alone = at.withColumn("upto", earlier).where("upto is null or upto <= start")
    k = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    added = alone.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(k.cast("int").alias("k"), "kind", "start", "end"))).alias("added"))
    base = F.transform("base", lambda s: s.dropFields("text", "left", "right"))
    return rows.select("row", "doc_id", base.alias("base")).join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<k:int,kind:string,start:int,end:int>>")).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

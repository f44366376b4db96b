"""Line deduplication by a segment-partition edit join (Li, Deng, Wang and Feng, 2011), in DataFrame functions only.

Of each class of lines the first (smallest document id, then position) stays and the others go. Equal lines are one
class, whatever their length; lines of ``min_chars`` code points or more join the class of any other such line within
``EDITS`` insertions, deletions or replacements, and so on from line to line.

1. Exact copies are counted on 128-bit hashes with aggregation before the shuffle, so a line of any frequency is one row.
2. A line of length l is cut into EDITS + 1 segments, and each is an index row (segment number, l, segment). Of two lines
   within EDITS edits the longer holds one of the other's segments near its place: for each length from l - EDITS to l the
   substrings that can be it are probed (the multi-match-aware selection). Both sides are rows of two numbers, key and line.
   The texts of lines that met another one are read after that, once. Counts of seven letters, taken of these lines only, rule
   out most pairs that differ in more than a few characters.
3. A segment that more than ``HOT`` lines index (a template, a family of variants) isn't paired as it is. Its lines get two
   sketches of 64 bits, in which each edit flips four bits at most. First each line is compared with ``STARS`` lines of its
   segment only, so that a family of any size costs a few pairs a line; then lines of the segment that are still in different
   components and whose sketches allow it. A segment with more than ``BLOCK`` such lines is first split by their rarest
   grams: an edit takes ``GRAM`` grams of a line at most, so of two lines within EDITS edits the rarest GRAM * EDITS + 1
   have one in common, in any one order of all grams. A template's own grams are frequent and bring nothing together, so
   what is copied follows the number of lines. A gram that is among the rarest and yet has more than a block is dealt in blocks.
4. Candidate pairs are verified on whole lines by a banded bit-parallel edit distance: a fold over the shorter line with the
   band's vertical differences as bits of one number, after what both lines share at their ends is set aside. Pairs that have
   fewer than 2 * EDITS of the shorter line's 3 * EDITS parts in common, near their places, can't be links and aren't folded.
5. Links give classes (connected components), classes give each occurrence its verdict. No link between classes is
   passed over; links within a class that a shorter path already joined aren't all listed.

Tables of copies, classes and candidates, and the texts of lines that met, are broadcast up to ``BROADCAST_BYTES`` and joined by a
shuffle beyond.

Two edits turn a short line into another line altogether, so ``min_chars`` (16) is a parameter: on both ends of a link.

Defined cases: a line without a word is left alone; a null text stays null and an empty one empty; rows that repeat an id and a
text are one document and get equal results; a null id comes last; other columns are kept; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecurve.llm.common import BROADCAST_BYTES, ROW_BYTES, WIDE_BYTES, fits, released, small, small_lists, written
from tidecurve.llm.graph import components

EDITS, MIN_CHARS = 2, 16
#: Lines that index a segment beyond which it is hot; lines of it that all others are compared with first; lines in a block.
HOT, STARS, BLOCK = 16, 4, 4096
#: Code points of a gram; slots in which grams are counted (a table of 4 MB at most, which is broadcast).
GRAM, SLOTS = 3, 1 << 18
LETTERS = "etaonir"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: An encoding of so many bytes for each code point: a substring's place is known, so that no code point before it is looked at.
WIDE, WIDTH = "UTF-32", 4


def hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(7), line)


def _segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of each segment of a line of a length: even ones, the longer ones last."""
    parts = edits + 1
    base = F.floor(length / parts).cast("int")
    short = parts - (length - base * parts)  # so many have the smaller length
    return [((F.lit(1) + i * base + F.greatest(F.lit(0), F.lit(i) - short)).cast("int"), (base + (F.lit(i) >= short).cast("int")).cast("int")) for i in range(parts)]


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(WHITE)) != ""


def _piece(wide: Column, start: Column, size: Column) -> Column:
    return F.substring(wide, (start - 1) * WIDTH + 1, size * WIDTH)


def index_keys(wide: Column, length: Column, edits: int = EDITS) -> list[Column]:
    """Keys of a line's segments. wide: the line in WIDE."""
    return [F.xxhash64(F.lit(i), length, _piece(wide, start, size)) for i, (start, size) in enumerate(_segments(length, edits))]


def probe_keys(wide: Column, length: Column, edits: int = EDITS) -> list[Column]:
    """Keys of the substrings that may be a segment of a line that is up to `edits` shorter."""
    found = []
    for less in range(edits + 1):
        other = (length - less).cast("int")
        for i, (start, size) in enumerate(_segments(other, edits)):
            for move in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                found.append(F.xxhash64(F.lit(i), other, _piece(wide, start + move, size)))
    return found


def banded_distance(long: Column, short: Column, most: int = EDITS) -> Column:
    """Edit distance of two arrays of characters, the first not the shorter one; most + 1 if it is over `most`.

    Bits of one number are the vertical differences in a band of 2 * most + 2 rows that moves down with each column
    (Hyyro, 2003); the distance is followed along the band's lower edge, then along the last row."""
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    n, m = F.size(long), F.size(short)
    low = lambda i: i + most - (width - 1)
    bit = lambda i, b: F.when(F.get(long, low(i) + b) == F.get(short, i), 1 << b).otherwise(0)

    def matches(i: Column) -> Column:
        total = bit(i, 0)
        for b in range(1, width):
            total = total + bit(i, b)
        return total

    masks = F.transform(F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.expr("cast(array() as array<int>)")), matches)
    first = F.struct(F.lit((full >> (width - most - 1)) << (width - most - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(most).alias("dist"), F.lit(0).alias("i"), F.lit(top >> 1).alias("row"))

    def step(acc: Column, x: Column) -> Column:
        vp, vn, i, row = acc["vp"], acc["vn"], acc["i"], acc["row"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))
        hp = vn.bitwiseOR(F.lit(full) - d0.bitwiseOR(vp))
        hn = d0.bitwiseAND(vp)
        right = F.shiftright(d0, 1)
        falls = i < n - most  # the lower edge is above the last row still
        along = F.when(d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
        across = F.when(hp.bitwiseAND(row) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(row) != 0, 1).otherwise(0)
        return F.struct(
            hn.bitwiseOR(F.lit(full) - right.bitwiseOR(hp)).alias("vp"), right.bitwiseAND(hp).alias("vn"), (acc["dist"] + F.when(falls, along).otherwise(across)).alias("dist"),
            (i + 1).alias("i"), F.when(falls, row).otherwise(F.shiftright(row, 1)).alias("row"),
        )

    told = F.aggregate(masks, first, step)["dist"]
    return F.when(n - m > most, most + 1).when(n <= most, F.least(F.levenshtein(F.array_join(long, ""), F.array_join(short, "")), F.lit(most + 1))).otherwise(F.least(told, F.lit(most + 1)))


def characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def common_prefix(x: Column, y: Column, length: Column) -> Column:
    """Length of the common prefix of two strings, `length` at most: by halving steps that compare whole substrings."""
    step = lambda p, n: p + F.when((p + n <= length) & (F.substring(x, p + 1, n) == F.substring(y, p + 1, n)), n).otherwise(0)
    powers = F.transform(F.sequence(F.floor(F.log2(length + 1)).cast("int"), F.lit(0)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    return F.aggregate(powers, F.lit(0), step)


def letter_counts(line: Column) -> Column:
    """Counts of some frequent letters, up to 255, as the bytes of one number: an edit changes their sum of differences by 2
    at most."""
    total = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        n = F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))
        total = total.bitwiseOR(F.shiftleft(F.least(n, F.lit(255)).cast("long"), 8 * i))
    return total


def letters_fit(a: Column, b: Column, edits: int = EDITS) -> Column:
    byte = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
    apart = F.lit(0).cast("long")
    for i in range(len(LETTERS)):
        apart = apart + F.abs(byte(a, i) - byte(b, i))
    return apart <= 2 * edits


def parts_fit(long: Column, short: Column, length: Column, edits: int = EDITS) -> Column:
    """Of 3 * edits even parts of the shorter line (of a length) an edit hits one at most: the others are in the longer one, and
    `edits` code points from their places at most."""
    parts, held = 3 * edits, F.lit(0)
    edge = lambda i: F.floor(length * i / parts).cast("int")
    for i in range(parts):
        start, size = edge(i) + 1, edge(i + 1) - edge(i)
        held = held + F.contains(F.substring(long, F.greatest(start - edits, F.lit(1)), size + 2 * edits), F.substring(short, start, size)).cast("int")
    return held >= parts - edits


def lines_of(docs: DataFrame, distinct: bool = False) -> DataFrame:
    """key, version (a hash of the text), pos, line, h1, h2 of the lines with a word; with distinct, each line of a text once."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    cut = docs.select("key", F.xxhash64("text").alias("version"), F.posexplode(F.array_distinct(lines) if distinct else lines).alias("pos", "line")).where(has_word(F.col("line")))
    h1, h2 = hashes(F.col("line"))
    return cut.select("*", h1.alias("h1"), h2.alias("h2"))


def sketches(line: Column) -> Column:
    """struct(s, t): two 64-bit parities of a line's hashed pairs of neighbouring characters. A replaced character changes
    two pairs, an inserted or deleted one takes or gives one and two: an edit flips four bits of either at most."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))

    def step(acc: Column, c: Column) -> Column:
        h, first = F.xxhash64(acc["last"], c), acc["last"].isNull()
        flip = lambda x, n: F.when(first, acc[x]).otherwise(acc[x].bitwiseXOR(bit(F.shiftright(h, n)))).alias(x)
        return F.struct(c.alias("last"), flip("s", 0), flip("t", 6))

    return F.aggregate(characters(line), start, step, lambda acc: F.struct(acc["s"].alias("s"), acc["t"].alias("t")))


def sketches_fit(x: str, y: str, edits: int = EDITS) -> Column:
    apart = lambda c: F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")))
    return (apart("s") <= 4 * edits) & (apart("t") <= 4 * edits)


def short_texts(texts: DataFrame) -> DataFrame:
    """As small(), for lines: their bytes are counted."""
    size = texts.agg(F.sum(F.octet_length("line").cast("long") + ROW_BYTES + WIDE_BYTES)).first()[0] or 0
    return F.broadcast(texts) if size <= BROADCAST_BYTES else texts


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs a, b of line hashes the links a1, a2, b1, b2 (two hashes each). texts: h1, h2, line, length."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("a1"), F.col("a").alias("a2"), F.col("b").alias("b1"), F.col("b").alias("b2"))
    texts = short_texts(texts)
    left, right = (texts.select(F.col("h1").alias(x), F.col("h2").alias(f"{x}2"), F.col("length").alias(f"{x}n"), F.col("line").alias(f"{x}l")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").where(F.abs(F.col("an") - F.col("bn")) <= EDITS)
    swap = F.col("an") < F.col("bn")
    long, short = F.when(swap, F.col("bl")).otherwise(F.col("al")), F.when(swap, F.col("al")).otherwise(F.col("bl"))
    both = both.select("a", "a2", "b", "b2", F.greatest("an", "bn").alias("n"), F.least("an", "bn").alias("m"), long.alias("long"), short.alias("short"))
    both = both.where(parts_fit(F.col("long"), F.col("short"), F.col("m")))
    # What two lines share at both ends isn't verified anew: the fold runs over the parts between.
    both = both.withColumn("head", common_prefix(F.col("long"), F.col("short"), F.col("m")))
    both = both.withColumns({"rest": F.col("m") - F.col("head"), "back_long": F.reverse("long"), "back_short": F.reverse("short")})
    both = both.withColumn("tail", common_prefix(F.col("back_long"), F.col("back_short"), F.col("rest")))
    middle = lambda x, n: characters(F.substring(x, F.col("head") + 1, F.col(n) - F.col("head") - F.col("tail"))).alias(x)
    # Written, as a filter would be pushed below these columns with all their expressions put in its place.
    both = written(both.select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2", middle("long", "n"), middle("short", "m")), "middles")
    links = written(both.where(banded_distance(F.col("long"), F.col("short")) <= EDITS).select("a1", "a2", "b1", "b2"), "links")
    released(pairs, both)
    return links


def star_pairs(rows: DataFrame) -> DataFrame:
    """a, b: every line of a hot segment with STARS lines that index it. rows: k, id, asks (a probe, not an index row), s, t."""
    drawn = rows.where("not asks").groupBy("k").agg(*[F.min_by(F.struct("id", "s", "t"), F.xxhash64(F.lit(i), "id")).alias(f"star{i}") for i in range(STARS)])
    met = rows.join(drawn, "k").select("id", "s", "t", F.explode(F.array(*[f"star{i}" for i in range(STARS)])).alias("star"))
    met = met.select(F.col("id").alias("b"), F.col("s").alias("bs"), F.col("t").alias("bt"), F.col("star.id").alias("a"), F.col("star.s").alias("as"), F.col("star.t").alias("at"))
    return met.where((F.col("a") != F.col("b")) & sketches_fit("a", "b")).select("a", "b")


def rare_grams(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """id, grams: hashes of the GRAM * edits + 1 rarest grams of each line. Lines with fewer distinct ones share another
    entry, 0, as two of them may have no gram in common. lines: id, line."""
    most = GRAM * edits
    # At each code point (not within a surrogate pair) what starts there, without taking it.
    found = F.regexp_extract_all("line", F.lit(r"(?s)(?=([^\uDC00-\uDFFF]" + "." * (GRAM - 1) + "))"), F.lit(1))
    cut = lines.repartition("id").select("id", F.explode_outer(F.array_distinct(F.transform(found, lambda g: F.xxhash64(g)))).alias("gram"))
    cut = cut.withColumn("slot", F.pmod("gram", F.lit(SLOTS)))
    counted = F.broadcast(cut.where("gram is not null").groupBy("slot").agg(F.count("*").alias("n")))
    ranked = F.array_sort(F.collect_list(F.when(F.col("gram").isNotNull(), F.struct("n", "gram"))))
    told = cut.join(counted, "slot", "left").groupBy("id").agg(ranked.alias("ranked"))
    rarest = F.transform(F.slice("ranked", 1, most + 1), lambda g: g["gram"])
    return told.select("id", F.when(F.size("ranked") > most, rarest).otherwise(F.concat(rarest, F.array(F.lit(0).cast("long")))).alias("grams"))


def mixed_groups(rows: DataFrame, block: int) -> DataFrame:
    """k, own, asked: segments that join lines of different components, and their blocks of index rows and of probes."""
    kinds = rows.groupBy("k").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum((~F.col("asks")).cast("int")).alias("own"), F.sum(F.col("asks").cast("int")).alias("asked"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int").alias(n)
    return kinds.where("low <> high and own > 0 and asked > 0").select("k", blocks("own"), blocks("asked"))


def dealt(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Index rows and probes with the pair of blocks they meet in: a row is copied once for each block of the other side."""
    groups = mixed_groups(rows, block)
    placed = rows.join(F.broadcast(groups) if fits(rows) else groups, "k").withColumn("at", F.xxhash64("id"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda x, i, j: (F.col("k").alias(f"{x}k"), i.alias(f"{x}i"), j.alias(f"{x}j"), F.col("id").alias(x), F.col("component").alias(f"{x}c"), F.col("s").alias(f"{x}s"), F.col("t").alias(f"{x}t"))
    own = placed.where("not asks").withColumn("of", each("asked")).select(*side("a", F.pmod("at", "own"), F.col("of")))
    return own, placed.where("asks").withColumn("of", each("own")).select(*side("b", F.col("of"), F.pmod("at", "asked")))


def mixed_pairs(rows: DataFrame, lines: DataFrame, block: int) -> DataFrame:
    """a, b: lines of a hot segment in different components whose sketches allow a link. rows: k, id, asks, component, s, t;
    lines: id, line."""
    crowded = written(mixed_groups(rows, block).where("own > 1 or asked > 1").select("k"), "crowded")
    if not crowded.isEmpty():
        many = rows.join(small(crowded), "k", "left_semi")
        inside = written(many.select("id").distinct(), "crowded_lines")
        keys = written(rare_grams(lines.join(small(inside), "id", "left_semi")), "grams")
        finer = many.join(keys, "id").withColumn("gram", F.explode("grams")).withColumn("k", F.xxhash64("k", "gram")).drop("gram", "grams")
        rows = written(rows.join(small(crowded), "k", "left_anti").unionByName(finer), "hot_rows")
    own, asked = dealt(rows, block)
    same = (own["ak"] == asked["bk"]) & (own["ai"] == asked["bi"]) & (own["aj"] == asked["bj"])
    return own.join(asked, same & (F.col("ac") != F.col("bc")) & sketches_fit("a", "b")).select("a", "b")


def name(a: str, b: str) -> Column:
    return F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))


def named(links: DataFrame) -> DataFrame:
    """The ends of links, each named by two hashes."""
    return links.select(name("a1", "a2").alias("a"), name("b1", "b2").alias("b"))


def near_lines(docs: DataFrame, counted: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Edges a, b (names of different lines) that join all lines that are joined by links of EDITS edits at most, and no others.
    counted: h1, h2, first, n of all lines."""
    copied = written(counted.where("n > 1").select("h1", "h2", "first"), "copied")
    fuzzy = lines_of(docs, distinct=True).withColumn("length", F.length("line")).where(F.col("length") >= min_chars)
    once = fuzzy.join(small(copied), ["h1", "h2"], "left").where(F.col("first").isNull() | (F.col("first") == F.col("key"))).withColumn("wide", F.encode("line", WIDE))
    keyed = written(once.select(F.col("h1").alias("id"), F.array(*index_keys(F.col("wide"), F.col("length"))).alias("own"), F.array(*probe_keys(F.col("wide"), F.col("length"))).alias("asked")), "keyed")
    hot = written(keyed.select(F.explode("own").alias("k")).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("k"), "hot")
    own, asked = (keyed.select("id", F.explode(c).alias("k")) for c in ("own", "asked"))
    index, probes = own.join(small(hot), "k", "left_anti").withColumnRenamed("id", "a"), asked.withColumnRenamed("id", "b")
    # A task holds its share of the index: two numbers a row, HOT rows a key. Lines of one length meet in both directions.
    met = index.hint("shuffle_hash").join(probes, "k").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = written(met, "met")  # a pair may be there once for each segment: pairs are told apart with the others, when few are left
    rows = own.join(small(hot), "k", "left_semi").select("k", "id", F.lit(False).alias("asks")).unionByName(asked.join(small(hot), "k", "left_semi").select("k", "id", F.lit(True).alias("asks")))
    rows = written(rows.distinct(), "hot_rows")
    ends = met.select(F.explode(F.array("a", "b")).alias("h1"), F.lit(False).alias("hot")).unionByName(rows.select(F.col("id").alias("h1"), F.lit(True).alias("hot")))
    wanted = written(ends.groupBy("h1").agg(F.max("hot").alias("hot")), "wanted")
    texts = lines_of(docs).where(F.length("line") >= min_chars).join(small(wanted), "h1").groupBy("h1", "h2", "hot").agg(F.first("line").alias("line"))
    texts = written(texts.withColumn("length", F.length("line")), "lines")
    counts = written(texts.select("h1", letter_counts(F.col("line")).alias("letters")), "letters")
    x, y = (small(counts).select(F.col("h1").alias(c), F.col("letters").alias(f"{c}n")) for c in "ab")
    pairs = met.join(x, "a").join(y, "b").where(letters_fit(F.col("an"), F.col("bn"))).select("a", "b")
    released(keyed, copied, hot, wanted)
    if rows.isEmpty():
        return named(verified(pairs, texts))
    lines = texts.where("hot").select(F.col("h1").alias("id"), name("h1", "h2").alias("node"), sketches(F.col("line")).alias("both"))
    lines = written(lines.select("id", "node", "both.s", "both.t"), "sketches")
    rows = written(rows.join(lines, "id"), "hot_rows")
    links = verified(pairs.unionByName(star_pairs(rows)), texts)
    joined = written(components(named(links)), "components")
    rows = rows.join(small(joined), "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = verified(mixed_pairs(rows.drop("node"), texts.select(F.col("h1").alias("id"), "line"), BLOCK), texts)
    # Of the links so far the components: their paths are short.
    return joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(named(more))


def decisions(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """key, version, pos, class, size, dropped of every line that has a copy or a near line; a class is named by two
    hashes, and size is the number of different lines in it."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counted = written(lines_of(docs).groupBy("h1", "h2").agg(F.min("key").alias("first"), F.count("*").alias("n")), "counted")
    near = written(components(near_lines(docs, counted, min_chars)), "near")
    known = counted.withColumn("node", name("h1", "h2")).join(small(near), "node", "left").where("n > 1 or component is not null")
    known = written(known.withColumn("class", F.coalesce("component", "node")).select("h1", "h2", "first", "class"), "known")
    firsts = known.groupBy("class").agg(F.min("first").alias("first"), F.count("*").alias("size"))
    table = written(known.drop("first").join(F.broadcast(firsts) if fits(known) else firsts, "class"), "classes")
    found = lines_of(docs).join(small(table), ["h1", "h2"]).select("key", "version", "pos", "class", "size", "first")
    place = F.dense_rank().over(Window.partitionBy("key", "class").orderBy("version", "pos"))
    return found.withColumn("place", place).select("key", "version", "pos", "class", "size", (~(F.col("key").eqNullSafe(F.col("first")) & (F.col("place") == 1))).alias("dropped"))


def by_document(told: DataFrame) -> DataFrame:
    """key, version, dropped (sorted line numbers), near (lines whose class holds other texts), classes (theirs and those of
    dropped lines, sorted) of the documents that decisions() names."""
    # Rows that repeat a text have equal lines: a set holds each once.
    lines = F.sort_array(F.collect_set(F.struct("pos", "class", "dropped", "size"))).alias("lines")
    found = told.groupBy("key", "version").agg(lines)
    found = found.select(
        "key", "version", F.transform(F.filter("lines", lambda x: x["dropped"]), lambda x: x["pos"]).alias("dropped"),
        F.size(F.filter("lines", lambda x: x["size"] > 1)).cast("long").alias("near"), F.col("lines").alias("classes"),
    )
    return found.withColumn("classes", F.transform("classes", lambda c: F.concat_ws(":", c["pos"].cast("string"), c["class"])))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each row of docs: key, n_lines (with a word), n_dropped, n_near (lines whose class holds other texts), dropped
    (line numbers), classes (line number:class of each line that has a copy or a near line)."""
    told = by_document(decisions(docs, key, text, min_chars)).withColumnRenamed("key", "told_key")
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size(F.filter(F.split(t, "\n", -1), has_word)).cast("long")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("v"), n.alias("n_lines"))
    joined = rows.join(told, rows["key"].eqNullSafe(told["told_key"]) & (rows["v"] == told["version"]), "left")
    dropped = F.coalesce("dropped", F.expr("cast(array() as array<int>)"))
    return joined.select(
        F.col("key").alias(key), "n_lines", F.size(dropped).cast("long").alias("n_dropped"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.array_join(dropped.cast("array<string>"), ",").alias("dropped"), F.coalesce(F.array_join("classes", ","), F.lit("")).alias("classes"),
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the dropped lines taken out of their texts; all rows and columns stay."""
    told = written(by_document(decisions(docs, key, text, min_chars)).select("key", "version", "dropped").where(F.size("dropped") > 0), "dropped").select(F.col("key").alias("__key"), F.col("version").alias("__version"), F.col("dropped").alias("__dropped"))
    joined = docs.join(small_lists(told), docs[key].eqNullSafe(told["__key"]) & (F.xxhash64(docs[text]) == told["__version"]), "left")
    lines = F.split(docs[text], "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    clean = F.when(F.col("__dropped").isNull(), docs[text]).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return joined.select(*[clean.alias(c) if c == text else docs[c] for c in docs.columns])

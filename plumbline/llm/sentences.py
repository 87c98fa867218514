"""Sentence units of texts in any language or script, in SQL expressions only.

A text is worked on in a copy in which every change keeps each character's place: stops that end no sentence (decimals, initials,
abbreviations, stops inside quotations and brackets whose sentence runs on) give way to a placeholder of the private use area, line breaks become hard breaks or
spaces. Boundary signs are then put in after true stops, by rules for each kind of script, and the copy is split at them. The lengths of the pieces,
summed up, are places in the original text, from which the sentence itself is taken, so nothing has to be restored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Placeholders: a masked stop, a hard break, the end of a leading mark, a boundary; and for a while, where what closes a quotation begins, and a closing mark set apart.
STOP, BREAK, MARK, CUT, TAIL, KEEP = (chr(0xE000 + i) for i in range(6))
WS = r"[\s\p{Z}]"
BLANKS = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000" + BREAK

# Abbreviations that never end a sentence, as a name or word follows.
TITLES = (
    "Dr Mr Mrs Ms Mx Prof Capt St Messrs Gen Sen Rep Lt Col Sgt Rev Hon Gov Pres Supt "
    "Fr Hr Fa Frl Dipl Bd Str bzw ggf vgl evtl sog inkl zzgl "
    "Sr Sra Srta Dra Ing Lic Ud Uds Mme Mlle Mmes Mgr MM "
    "проф Проф доц акад ул пл пер просп обл г-н им См см ср гр тов "
    "د أ م ص प्रो डॉ श्री"
).split()
# Abbreviations that go on when a number follows.
NUMBERED = (
    "No no Nos nos Nr Nrn Num num Fig Figs fig figs Figure Abb Tab tab Eq eq Sec Sect sec Ch ch Vol vol pp p P art Art Bd S ca approx aprox env cca ed éd rév rev vers v n núm "
    "pág págs cap Kap kap cf cfr vs рис табл стр с гл п № вып т ص ج c q "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec janv févr avr juil sept oct nov déc ene feb abr jun jul ago dic Mär Okt Dez"
).split()
# Month names that follow an ordinal written with a stop.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# German words before an ordinal written with a stop.
ARTICLES = "der die das den dem des am im vom zum beim zur ab Der Die Das Den Dem Des Am Im Vom Zum Beim Zur Ab".split()

QUOTES_END = "”’»」』〉》】）)\\]\"'"
STOPS = ".!?…؟۔।॥。！？｡"
WIDE = "。！？｡"
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"


def _any(words: list[str]) -> str:
    both = {*words, *(w[0].upper() + w[1:] for w in words if len(w) > 1)}
    return "(?:" + "|".join(sorted(both, key=lambda w: (-len(w), w))) + ")"


_WORD_START = r"(?<![\p{L}\p{N}\p{M}])"
_MARKS = r"(?:#{1,6}|[-*+•‣◦]|>|[0-9]{1,3}[.)])"


def _inside(o: str, c: str) -> list[tuple[str | None, str | None, str]]:
    """Rules for stops within quotation marks or brackets that close again, where words follow before they do.

    The last signs before a mark, after which no word follows, are set apart first. Then, from an opening mark or the stop found last, on to
    the next stop: every sign is passed over a fixed number of times, however long the quotation.
    """
    own, rest = f"[^{o}{c}{BREAK}", rf"[^\p{{L}}\p{{N}}{o}{c}]"
    return [
        (o, rf"((?:[{o}](?={own}]*+[{c}])|\G(?!\A)){own}{STOPS}]*+)([{STOPS}]{rest}*+)", rf"$1{TAIL}$2"),
        (TAIL, rf"{TAIL}([{STOPS}]{rest}*+)(?=[\p{{L}}\p{{N}}])", "$1"),
        (o, rf"((?:[{o}](?={own}]*+[{c}])|\G(?!\A)){own}{STOPS}{TAIL}]*+)[{STOPS}]", rf"$1{STOP}"),
        (TAIL, None, ""),
    ]


# Stops that end no sentence. Each alternative looks behind only once a stop is found.
_MASKED = [
    rf"(?=[{STOPS}]{{4}})",  # of a long run of stops the last four are enough
    r"(?<=\p{N}[.])(?=\p{N})",  # decimals, versions, addresses
    rf"(?<={_WORD_START}\p{{L}}[.])(?={WS}{{0,2}}\p{{L}}[.])",  # letters set apart (z. B., i. d. R.)
    rf"(?<={_WORD_START}\p{{Lu}}[.])(?={WS}{{0,2}}\p{{L}})",  # initials
    rf"(?<={_WORD_START}{_any(TITLES)}[.])(?={WS})",
    rf"(?<={_WORD_START}{_any(NUMBERED)}[.])(?={WS}{{0,2}}\p{{N}})",
    rf"(?<=\p{{N}}[.])(?={WS}{{1,2}}{_any(MONTHS)}\b)",
    rf"(?<=(?<![\p{{L}}\p{{M}}]){_any(ARTICLES)}{WS}[0-9]{{1,3}}[.])(?={WS}{{1,2}}\p{{Lu}})",  # ordinals
    # Right before they close: a bracket opened within a sentence; a title; a quotation after which the sentence runs on.
    rf"(?=[{STOPS}]{{0,3}}[”」]?{KEEP}[)）])",
    rf"(?=[{STOPS}]{{0,3}}》)",
    rf"(?=[{STOPS}]{{0,3}}[」』][{CJK}、，])",
    rf"(?=[{STOPS}]{{0,3}}{WS}?[”»]{WS}?[\p{{Lo}}、，])",
]
# Where a sentence ends: what is matched, a boundary follows.
_ENDS = [
    # Scripts without spaces between sentences.
    rf"(?:[{WIDE}][{STOPS}]*[{QUOTES_END}]*|…[{STOPS}]*[{QUOTES_END}]*(?=[{CJK}（「『“《]))(?![{QUOTES_END}{STOPS}\s\p{{Z}}]|$)",
    # Scripts with spaces: a stop, what closes, a space, and a start that is no small letter (or a name such as iName).
    rf"[{STOPS}](?:{WS}?»|[{QUOTES_END}])*+{WS}+(?=[^\p{{Ll}}\p{{Pd}}\s\p{{Z}}{QUOTES_END}{STOPS}{BREAK}{MARK}{CUT},;:]|\p{{Ll}}\p{{Lu}})",
    # A space that was forgotten.
    rf"(?<=[\p{{Ll}}\p{{M}}]{{2}}|[.{STOP}]m|\p{{Ll}}[)”»]|\p{{N}})[.!?…][)”»]*(?=\p{{Lu}}[\p{{Ll}}\s{STOP}]|\p{{Ll}}\p{{Lu}}\p{{Ll}})",
    # Thai: a space is the stop.
    r"(?<=[\u0e00-\u0e7f0-9)”])[\s\p{Z}]+(?=[\u0e00-\u0e7f])",
]
# The rules, in order: characters without one of which there is nothing to do, pattern (Java), replacement. Every one keeps the number of
# characters, until those that put in MARK and CUT.
RULES = [
    (STOP + BREAK + MARK + CUT + TAIL + KEEP, rf"[{STOP}-{KEEP}]", "\uf8ff"),
    ("\r", "\r\n", " \n"),
    ("\r\u2028\u2029", "[\r\u2028\u2029]", "\n"),
    # A blank line; a next line that is a heading, list item or quotation; the end of a heading.
    ("\n", rf"\n(?=[ \t\p{{Zs}}]*\n)|\n(?=[ \t]*(?:#{{1,6}}[ \t]|[-*+•‣◦][ \t]|>|[0-9]{{1,3}}[.)][ \t](?!{_any(MONTHS)}\b)))", BREAK),
    ("#", rf"(?<![^\n{BREAK}])([ \t]{{0,3}}#{{1,6}}[ \t][^\n{BREAK}]*)\n", rf"$1{BREAK}"),
    ("\n", None, " "),
    ("„", rf"„([^„“”{BREAK}]*+)[“”]", "“$1”"),
    ('"', rf"(?<![^\s\p{{Z}}(\[（“‘«¿¡{BREAK}—–])\"(?=\S)", "“"),
    ('"', None, "”"),
    # A number that opens a heading or item.
    ("#-*+•‣◦>", rf"(?<![^{BREAK}])([ \t]*{_MARKS}[ \t]+[0-9]{{1,3}})[.](?={WS})", rf"$1{STOP}"),
    *(rule for o, c in (("“", "”"), ("«", "»"), ("「", "」"), ("(（", ")）")) for rule in _inside(o, c)),
    # A bracket opened within a sentence; a quotation after a colon.
    ("(（", rf"([(（](?<=[\p{{L}}\p{{M}}\p{{N}},;:%]{WS}{{0,2}}[(（])[^()（）{BREAK}]*+)(?=[)）])", rf"$1{KEEP}"),
    ("“«", rf"([:：][“«][^“”«»{BREAK}]*+)(?=[”»])", rf"$1{KEEP}"),
    (STOPS, rf"[{STOPS}](?:{'|'.join(_MASKED)})", STOP),
    (KEEP, None, ""),
    (None, rf"(?<![^{BREAK}])((?:[ \t]*{_MARKS}(?:[ \t]+|(?={BREAK}|$)))++)", rf"$1{MARK}{CUT}"),
    (BREAK, None, BREAK + CUT),
    (None, "|".join(_ENDS), rf"$0{CUT}"),
]


def marked(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the copy of a text with placeholders and boundary signs; without MARK and CUT it has as many characters as the text.

    One projection a rule: a text is only handed to a pattern if it holds one of the characters it is about.
    """
    rows = rows.withColumn(out, F.col(text))
    for needs, pattern, new in RULES:
        c = F.col(out)
        done = F.regexp_replace(c, pattern, new) if pattern else F.replace(c, F.lit(needs), F.lit(new))
        if needs and pattern:
            holds = F.lit(False)
            for n in needs:
                holds = holds | F.contains(c, F.lit(n))
            done = F.when(holds, done).otherwise(c)
        rows = rows.withColumn(out, done)
    return rows


def _starts(sizes: Column) -> Column:
    """Sums of all sizes before each. Its work grows with the square of their number: for the pieces of a block, or the blocks."""
    none = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(sizes, none, lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.array_append(a["starts"], a["sum"]).alias("starts")), lambda a: a["starts"])


def _units(pieces: Column, body: Column, with_text: bool) -> Column:
    """Array of (start, end[, sentence]) of the pieces that are units, counted from the body's start.

    Pieces are taken in blocks of about the square root of their number, and a sentence is cut from its block, so a long text is not walked through from its start for each of them.
    """
    n = F.size(pieces)
    width = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), n, width), lambda b: F.slice(pieces, b, width))
    total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["size"])

    def unit(x: Column, at: Column, off: Column, text: Column | None) -> Column:
        start = off + at + x["lead"]
        more = [] if text is None else [text.substr(at + x["lead"] + 1, x["core"]).alias("sentence")]
        return F.struct(start.alias("start"), (start + x["core"]).alias("end"), (~x["mark"] & (x["core"] > 0)).alias("is_unit"), *more)

    def of_block(block: Column, off: Column) -> Column:
        at = _starts(F.transform(block, lambda x: x["size"]))
        if not with_text:
            return F.zip_with(block, at, lambda x, s: unit(x, s, off, None))
        held = F.array(body.substr(off + 1, total(block)))  # cut once, then named
        return F.flatten(F.transform(held, lambda text: F.zip_with(block, at, lambda x, s: unit(x, s, off, text))))

    every = F.flatten(F.zip_with(blocks, _starts(F.transform(blocks, total)), of_block))
    return F.filter(every, lambda u: u["is_unit"])


def sentences(docs: DataFrame, cells: DataFrame, kind: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, sent_start, sent_end[, sentence]): the sentence units of the cells of one kind, places counted in code points of documents.text.

    cells: doc_id, kind, char_start, char_end. Headings, list items, lines closed by a blank line and whole sentences are units; leading heading, list and
    quotation marks and surrounding white space are left out. Everything follows the one shuffle by doc_id that brings cells to their texts (hashed on the side of the cells, which
    are numbers only); units are finished within their cell's row, so none carries its cell along.

    Null, empty and blank texts or cells have no units; a cell beyond the text's end is cut there. Repeated rows of cells count once; a repeated doc_id is taken
    once for each of its rows. Empty input: empty output.
    """
    spans = cells.where((F.col("kind") == kind) & (F.col("char_end") > F.col("char_start")) & (F.col("char_start") >= 0)).groupBy("doc_id").agg(F.collect_set(F.struct("char_start", "char_end")).alias("__cells"))
    texts = docs.where("text is not null").select("doc_id", "text")
    cut = lambda c: F.struct(c["char_start"].alias("at"), F.col("text").substr((c["char_start"] + 1).cast("int"), (c["char_end"] - c["char_start"]).cast("int")).alias("body"))
    body = texts.join(spans.hint("shuffle_hash"), "doc_id").select("doc_id", F.explode(F.transform("__cells", cut)).alias("__cell")).select("doc_id", F.col("__cell.at").alias("__at"), F.col("__cell.body").alias("__body"))

    def piece(p: Column) -> Column:
        is_mark, bare = p.endswith(MARK), F.ltrim(p, F.lit(BLANKS))
        return F.struct(is_mark.alias("mark"), (F.char_length(p) - is_mark.cast("int")).alias("size"), (F.char_length(p) - F.char_length(bare)).alias("lead"), F.char_length(F.trim(p, F.lit(BLANKS))).alias("core"))

    pieces = marked(body, "__body", "__copy").withColumn("__pieces", F.transform(F.split("__copy", CUT), piece))
    units = pieces.select("doc_id", "__at", F.explode(_units(F.col("__pieces"), F.col("__body"), with_text)).alias("__u"))
    place = lambda c: (F.col("__at") + F.col(f"__u.{c}")).cast("long").alias(f"sent_{c}")
    return units.select("doc_id", place("start"), place("end"), *(["__u.sentence"] if with_text else []))

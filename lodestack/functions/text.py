"""Column functions on text. None is a UDF: all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The code points that count as white space, the 32 ASCII punctuation marks, and the listed CJK marks.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
SPACES = "".join(chr(c) for a, b in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(a, b + 1))
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK_PUNCTUATION = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."
CJK = r"[\x{4E00}-\x{9FA5}]"


def strip(s: Column) -> Column:
    """Without white space at both ends, which alone are looked at."""
    return F.btrim(s, F.lit(SPACES))


def is_blank(s: Column) -> Column:
    return ~s.rlike(NOT_SPACE)


def split_space(s: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(s, f"{SPACE}+"), lambda w: w != "")


def normalize_answer(s: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces, in this order."""
    plain = F.translate(F.lower(s), PUNCTUATION, "")
    plain = F.regexp_replace(plain, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.trim(F.regexp_replace(plain, f"{SPACE}+", " "))


def normalize_zh_answer(s: Column) -> Column:
    """Lower case, without ASCII and CJK punctuation and without any white space."""
    return F.regexp_replace(F.translate(F.lower(s), PUNCTUATION + CJK_PUNCTUATION, ""), f"{SPACE}+", "")


def word_list(s: Column) -> Column:
    """Lower-case runs of letters, digits and _; each CJK character is a word of its own."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\x{4E00}-\x{9FA5}]|[\p{L}\p{N}_&&[^\x{4E00}-\x{9FA5}]]+"), F.lit(0))


def word_len(s: Column) -> Column:
    return F.size(word_list(s))


def count_words(s: Column) -> Column:
    """The token estimate of paragraph cutting: 1.2 per word, rounded."""
    return F.round(1.2 * F.size(split_space(s))).cast("int")


def is_english(s: Column) -> Column:
    """No CJK ideograph."""
    return ~s.rlike(CJK)


def sentences_en(s: Column) -> Column:
    """Sentences end behind . ! or ? where white space follows; that white space goes, and so do blank sentences."""
    marked = F.regexp_replace(s, f"([.!?]){SPACE}+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: x.rlike(NOT_SPACE))


def sentences_zh(s: Column) -> Column:
    """Sentences end behind a CJK or semicolon-like mark with at most two closing quotes, or behind ： before an opening quote or the end."""
    marked = F.regexp_replace(s, "([﹒﹔﹖﹗．；。！？][”’」』]{0,2})", "$1\u0001")
    marked = F.regexp_replace(marked, "：(?=[“‘「『]|$)", "：\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: x != "")


def sentences_zh_line(s: Column, rule: str = "intended") -> Column:
    """Sentences of a line for the model-driven chunker.

    ``intended`` ends one behind each full stop. ``literal`` ends one behind a
    character, not the first nor the last of the line, that is no full stop and
    has no digit on either side, once the sentence has six characters besides
    white space at its ends, which goes.
    """
    if rule == "intended":
        return F.filter(F.split(F.regexp_replace(s, "。", "。\u0001"), "\u0001"), lambda x: x != "")
    if rule != "literal":
        raise ValueError("rule is intended or literal")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("at"))
    n = F.char_length(s)
    digit = lambda c: c.rlike("^[0-9]$")

    def step(state: Column, c: Column) -> Column:
        at, now = state["at"], F.concat(state["open"], c)
        inner = (at >= 1) & (at < n - 1) & (c != "。") & ~digit(F.substr(s, at, F.lit(1))) & ~digit(F.substr(s, at + 2, F.lit(1)))
        end = inner & (F.char_length(strip(now)) > 5)
        return F.struct(F.when(end, F.concat(state["done"], F.array(strip(now)))).otherwise(state["done"]).alias("done"), F.when(end, F.lit("")).otherwise(now).alias("open"), (at + 1).alias("at"))

    characters = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(characters, start, step, lambda x: F.when(x["open"] != "", F.concat(x["done"], F.array(x["open"]))).otherwise(x["done"]))


def merge_short_sentences(sentences: Column, least: int = 10) -> Column:
    """Strips sentences and drops blank ones; one under ``least`` characters goes, with a space, before the next."""
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("carry"))

    def step(state: Column, x: Column) -> Column:
        joined = F.when(state["carry"].isNull(), x).otherwise(F.concat(state["carry"], F.lit(" "), x))
        short = F.char_length(joined) < least
        return F.struct(F.when(short, state["done"]).otherwise(F.concat(state["done"], F.array(joined))).alias("done"), F.when(short, joined).alias("carry"))

    clean = F.filter(F.transform(sentences, strip), lambda x: x != "")
    return F.aggregate(clean, start, step, lambda s: F.when(s["carry"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["carry"]))))


def truncate_sentence(s: Column, head: int, tail: int) -> Column:
    """Head and tail of a long sentence; the limits count tens of characters in English, characters otherwise."""
    factor = F.when(is_english(s), 10).otherwise(1)
    keep = factor * (head + tail)
    cut = F.concat(F.left(s, factor * head), F.when(F.lit(tail) > 0, F.right(s, factor * tail)).otherwise(F.lit("")))
    return F.when((F.lit(head + tail) > 0) & (keep < F.char_length(s)), cut).otherwise(s)


def heading_level(line: Column) -> Column:
    """The # marks in a line's leading run of # and spaces."""
    return F.char_length(F.replace(F.regexp_extract(line, "^[ #]*", 0), F.lit(" "), F.lit("")))


def replace_heading(line: Column, mark: str | None) -> Column:
    """Puts ``mark`` in place of a heading's leading run of # and spaces."""
    if mark is None:
        return line
    return F.when(heading_level(line) > 0, F.regexp_replace(line, "^[ #]*", mark)).otherwise(line)


def strip_heading(s: Column) -> Column:
    return F.regexp_replace(s, "^[# ]+", "")


def text_to_sentences(line: Column, head: int, tail: int, mark: str | None = None) -> Column:
    """A line's sentences for the chunker, one line each.

    Each sentence has its heading marks set aside, is cut short, and gets the
    marks back (or ``mark`` in their place).
    """
    parts = F.when(is_english(line), merge_short_sentences(sentences_en(line))).otherwise(sentences_zh_line(line))

    def one(x: Column) -> Column:
        level = heading_level(x)
        cut = truncate_sentence(replace_heading(x, "# "), head, tail)
        marked = F.when(level > 0, F.regexp_replace(cut, "^[ #]*", F.concat(F.repeat(F.lit("#"), level), F.lit(" ")))).otherwise(cut)
        return F.concat(replace_heading(marked, mark), F.lit("\n"))

    return F.transform(parts, one)


def numbered_sentences(lines: DataFrame, head: int = 15, tail: int = 15, mark: str | None = None, start: int = 0, key: str = "doc_id") -> DataFrame:
    """(key, i, text): the sentences of a document's lines (key, pos, text), counted on from ``start`` and led by their number."""
    each = lines.select(key, "pos", F.posexplode(text_to_sentences(F.col("text"), head, tail, mark)).alias("_s", "text"))
    i = F.row_number().over(Window.partitionBy(key).orderBy("pos", "_s")) - 1 + start
    return each.select(key, i.alias("i"), index_format(i, F.col("text")).alias("text"))


def index_format(i: Column, line: Column) -> Column:
    return F.concat(i.cast("string"), F.lit(" @ "), line)


def paragraph_id_format(i: Column, text: Column) -> Column:
    return F.concat(F.lit("ID "), i.cast("string"), F.lit(": "), text)


def strip_paragraph_id(s: Column) -> Column:
    return F.regexp_replace(s, rf"^ID [0-9]+:{SPACE}*", "")


def evidence_text(s: Column) -> Column:
    """Evidence as chunks hold it: heading marks off, and no space behind a full stop."""
    return F.replace(strip_heading(s), F.lit(". "), F.lit("."))


def strip_answer_mark(s: Column) -> Column:
    return F.replace(s, F.lit("Answer: "), F.lit(""))


def chunk_id(doc: Column, ordinal: Column) -> Column:
    return F.concat_ws("_", doc.cast("string"), ordinal.cast("string"))


def chunk_id_doc(s: Column) -> Column:
    return F.regexp_extract(s, r"^(.*)_([0-9]+)$", 1)


def chunk_id_ordinal(s: Column) -> Column:
    return F.regexp_extract(s, r"^(.*)_([0-9]+)$", 2).try_cast("int")


def after_thinking(s: Column) -> Column:
    return F.substring_index(s, "</think>", -1)


def answer_paragraph(s: Column) -> Column:
    """The paragraph number of a reply, null without one."""
    found = F.regexp_extract(F.regexp_extract(after_thinking(s), "Answer: ID [0-9]+", 0), "[0-9]+", 0)
    return F.when(found != "", found.cast("int"))


def json_object(s: Column) -> Column:
    """The text from the first { to the last } behind the thinking part."""
    return F.regexp_extract(after_thinking(s), r"(?s)\{.+\}", 0)


def file_key(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def fill_template(template: str, **values: Column) -> Column:
    """A template with {name} places and doubled braces; values are put in at once and never read again."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def middle_truncate(tokens: Column, most: int) -> Column:
    """The first and last ``int(most / 2)`` tokens of a longer list."""
    half = most // 2
    return F.when(F.size(tokens) > most, F.concat(F.slice(tokens, 1, half), F.slice(tokens, F.size(tokens) - half + 1, F.lit(half)))).otherwise(tokens)


def answer_lines(points: Column) -> Column:
    """Structs (point, level, title), in order of point and level, as lines "p, Level N, True"."""
    names = F.array(*[F.lit(f"Level {x}") for x in "One Two Three Four Five Six Seven Eight Nine Ten".split()])
    return F.array_join(F.transform(F.array_sort(points), lambda p: F.concat(p["point"].cast("string"), F.lit(", "), F.element_at(names, p["level"]), F.lit(", "), F.initcap(p["title"].cast("string")))), "\n")

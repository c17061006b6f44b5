"""Text functions as Column expressions; regular expressions name their classes, so results don't depend on a locale."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Short stop-word lists.
STOP_EN = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "this", "that", "it", "as", "from")
STOP_FA = ("و", "در", "به", "از", "که", "این", "آن", "با", "را", "برای", "است", "بود", "شد", "یا", "تا", "هم")
#: Lower bounds of the quality levels.
LEVELS = ((0.9, "excellent"), (0.8, "very good"), (0.7, "good"), (0.6, "fair"), (0.5, "weak"))
EMOJI = "[\U0001f300-\U0001faff☀-➿]"


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r]+", " "))


def safe_double(c: Column) -> Column:
    """Number of a string, 0 where there is none; Java's hexadecimal numbers and type suffixes ("1d") are none."""
    return F.when(c.rlike("(?i)x|[0-9.][df]\\s*$"), 0.0).otherwise(F.coalesce(c.try_cast("double"), F.lit(0.0)))


def clean(c: Column) -> Column:
    """Letters, digits, blanks and simple punctuation only (any script)."""
    return squeeze(F.regexp_replace(c, "[^\\p{L}\\p{M}\\p{N}_ \\t\\n\\r.,!?;:()-]", ""))


def normal(c: Column) -> Column:
    """Lower-case ASCII letters, digits and single blanks."""
    return squeeze(F.regexp_replace(F.lower(c), "[^a-z0-9 \\t\\n\\r]", ""))


def words(c: Column) -> Column:
    """Words of the normal form."""
    return F.filter(F.split(normal(c), " "), lambda w: w != "")


def truncate(c: Column, n: int) -> Column:
    """At most ``n`` characters, cut at the last blank, with dots."""
    head = F.substring(c, 1, n)
    at_blank = F.regexp_extract(head, "(?s)^(.*) ", 1)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.when(at_blank != "", at_blank).otherwise(head), F.lit("...")))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct elements; 0 of two empty arrays."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Common distinct elements over the smaller set: 1 if both are empty, 0 if one is."""
    x, y = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(x, y))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less edit distance over the longer length; 1 of two empty strings."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters."""
    return jaccard(F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, "")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def level(score: Column) -> Column:
    """Quality level of a score."""
    col = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for bound, name in LEVELS[1:]:
        col = col.when(score >= bound, name)
    return col.otherwise("poor")


def script_language(c: Column) -> Column:
    """fa if more than half of the visible characters are Persian, mixed above a tenth, else en."""
    seen = F.length(F.regexp_replace(c, "[ \\t\\n\\r]", ""))
    share = F.coalesce(F.try_divide(F.length(F.regexp_replace(c, "[^\\x{0600}-\\x{06FF}]", "")), seen), F.lit(0.0))
    return F.when(share > 0.5, "fa").when(share > 0.1, "mixed").otherwise("en")


def persian_normal(c: Column) -> Column:
    """Persian letters and digits for Arabic ones; joiners dropped."""
    return F.regexp_replace(F.translate(F.regexp_replace(c, "\\x{200C}", " "), "يكة٠١٢٣٤٥٦٧٨٩", "یکه۰۱۲۳۴۵۶۷۸۹"), "\\x{200D}", "")


def without_stop_words(c: Column, stop: tuple[str, ...] = STOP_EN + STOP_FA) -> Column:
    """Lower-case words split at blanks, without stop words and single characters; a letter's case depends on no other."""
    return F.array_join(F.filter(F.split(F.lower(F.translate(c, "İΣ", "iσ")), "[ \\t\\n\\r]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop)), " ")


def without_emoji(c: Column) -> Column:
    """Text without pictographs."""
    return F.regexp_replace(c, EMOJI, "")


def escape_query(c: Column) -> Column:
    """Query syntax characters escaped."""
    return F.trim(F.regexp_replace(c, '([:{}/\\[\\]\\-*"()|+~^])', "\\\\$1"))


def fulltext_keywords(c: Column, k: int = 10) -> Column:
    """Up to ``k`` words of more than one character, punctuation and leading question words removed."""
    plain = F.trim(F.regexp_replace(F.lower(c), "[ :|\\r\\n\\t,?/`!&^%()\\[\\]{}<>]+", " "))
    asked = F.regexp_replace(plain, "(^| )(what|who|how|which|where|why)('re|'s)? ", " ")
    return F.slice(F.filter(F.split(asked, " +"), lambda w: F.length(w) > 1), 1, k)


def sentences(c: Column) -> Column:
    """Sentences, cut behind an end mark and white space."""
    return F.filter(F.transform(F.split(c, "[.!?؟][ \\t\\n\\r]+"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """Paragraphs, cut at blank lines."""
    return F.filter(F.transform(F.split(c, "\\n[ \\t\\r]*\\n"), lambda s: F.trim(s)), lambda s: s != "")


def token_estimate(c: Column) -> Column:
    """Tokens by a rule of thumb: 1.33 for each word."""
    return F.floor(F.size(F.filter(F.split(c, "[ \\t\\n\\r]+"), lambda w: w != "")) * 1.33).cast("int")


def fixed_chunks(c: Column, size: int, overlap_chars: int) -> Column:
    """Array of (start, chunk) of a fixed width and overlap; the last ends with the text."""
    step = size - overlap_chars
    n = F.length(c)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.floor((n - overlap_chars - 1) / step) * step).cast("int"), F.lit(step)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr(c, s + 1, F.lit(size)).alias("chunk")))


def pack(parts: Column, most: int) -> Column:
    """Greedy packing: (parts joined by blanks, tokens) groups of at most ``most`` estimated tokens; a longer part stands alone."""
    empty = F.array().cast("array<struct<text:string,tokens:int>>")

    def add(acc: Column, s: Column) -> Column:
        t = token_estimate(s)
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(F.concat_ws(" ", last["text"], s).alias("text"), (last["tokens"] + t).alias("tokens"))
        alone = F.array(F.struct(s.alias("text"), t.alias("tokens")))
        fits = (F.size(acc) > 0) & (F.coalesce(last["tokens"], F.lit(most)) + t <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, alone))

    return F.aggregate(parts, empty, add)


def tokens(c: Column) -> Column:
    """Runs of letters, marks, digits and underscores of any script."""
    return F.split(c, "[^\\p{L}\\p{M}\\p{N}_]+")


def gene_symbols(c: Column) -> Column:
    """Tokens of capitals and digits that begin with a capital."""
    return F.filter(tokens(c), lambda w: w.rlike("^[A-Z][A-Z0-9]+\\z"))


#: Endings of drug names.
DRUG_ENDINGS = "ib|mab|zumab|umab|tinib|olol|pril|sartan|zevam|racin|tavol|nilide|xiline|morine"


def drug_names(c: Column) -> Column:
    """Tokens with the endings of drug names, in lower case."""
    return F.filter(tokens(F.lower(c)), lambda w: w.rlike(f"^[a-z]+(?:{DRUG_ENDINGS})\\z"))


def cache_key(*cols: Column) -> Column:
    """Stable key of a request: hash of its canonical JSON."""
    return F.xxhash64(F.to_json(F.struct(*cols)))


#: Shares of a limit that a cut at a paragraph, sentence or blank must keep, and the mark of a cut text.
KEPT = {"paragraph": 0.8, "sentence": 0.7, "blank": 0.9}
CUT_MARK = "\n\n[... متن ادامه دارد ...]"


def clean_lines(c: Column) -> Column:
    """Lines without blanks at their ends, at most one empty line in a row, single blanks, no control characters."""
    out = F.regexp_replace(c, "\r\n?", "\n")
    out = F.regexp_replace(out, "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]", "")
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+\\z", "")


def truncate_smart(c: Column, n: int) -> Column:
    """At most ``n`` characters, cut at the end of a paragraph, a sentence or a word where enough is kept, with a mark."""
    head = F.substring(c, 1, n)
    para = F.length(F.regexp_extract(head, "(?s)^(.*)\n\n", 1))
    sent = F.length(F.regexp_extract(head, "(?s)^(.*[.!?][ \n])", 1))
    blank = F.length(F.regexp_extract(head, "(?s)^(.*) ", 1))
    end = F.when(para > KEPT["paragraph"] * n, para).when(sent - 2 > KEPT["sentence"] * n, sent).when(blank > KEPT["blank"] * n, blank).otherwise(F.lit(n))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substr(c, F.lit(1), end), F.lit(CUT_MARK)))


def title_from_url(c: Column) -> Column:
    """Title of an encyclopedia page by its address, null for other addresses."""
    part = F.regexp_extract(c, "/wiki/([^?#]+)", 1)
    return F.when(part != "", F.replace(F.try_url_decode(part), F.lit("_"), F.lit(" ")))


def valid_url(c: Column) -> Column:
    """Whether a string is a web address with a host."""
    return F.coalesce(c.rlike("(?i)^https?://[^/?#\\s]+[^\\s]*\\z"), F.lit(False))


#: Endings of graph files.
GRAPH_FILES = ("pkl", "sif", "tsv", "csv", "txt", "gz")


def allowed_file(c: Column) -> Column:
    """Whether a file name has the ending of a graph file."""
    return F.coalesce(F.lower(F.regexp_extract(c, "\\.([^.]*)\\z", 1)).isin(*GRAPH_FILES), F.lit(False))


def mostly_not_latin(c: Column) -> Column:
    """Whether a text of more than three tokens has seven tenths that are more than ASCII letters; shorter ones count."""
    t = F.split(c, "[ \t]+")
    share = F.size(F.filter(t, lambda w: ~w.rlike("^[a-zA-Z]+\\z"))) / F.size(t)
    return (F.size(t) <= 3) | (share >= 0.7)


#: Relation of two entities by the first group of words that their sentence holds.
RELATION_WORDS = (
    ("REGULATES", ("regulates", "controls", "تنظیم", "کنترل")),
    ("INTERACTS_WITH", ("interacts", "binds", "تعامل", "اتصال")),
    ("TREATS", ("treats", "cures", "درمان", "معالجه")),
    ("CAUSES", ("causes", "leads", "سبب", "موجب")),
    ("PREVENTS", ("prevents", "inhibits", "جلوگیری", "مهار")),
    ("ACTIVATES", ("activates", "فعال", "فعالسازی")),
)
OTHER_RELATION = "ASSOCIATES_WITH"


def sentence_relation(c: Column) -> Column:
    """Relation that a sentence states, by its words."""
    q, col = F.lower(c), F.lit(OTHER_RELATION)
    for name, ws in reversed(RELATION_WORDS):
        held = F.lit(False)
        for w in ws:
            held = held | q.contains(w)
        col = F.when(held, name).otherwise(col)
    return col


#: Parts of a written comparison and the words of their headings.
ANSWER_PARTS = ("summary", "analysis", "strengths", "weaknesses", "recommendation")


def answer_part(c: Column) -> Column:
    """Part of a comparison that a paragraph belongs to, by the word its first line names; null for others."""
    first, col = F.lower(F.substring_index(c, "\n", 1)), F.lit(None).cast("string")
    for p in reversed(ANSWER_PARTS):
        col = F.when(first.contains(p), p).otherwise(col)
    return col


def valid_extraction(c: Column) -> Column:
    """Whether a JSON text is an extraction: lists of entities and of relationships."""
    e, r = F.get_json_object(c, "$.entities"), F.get_json_object(c, "$.relationships")
    return F.coalesce(e.startswith("[") & r.startswith("["), F.lit(False))

"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Case endings of Russian nouns and vowels that carry a syllable (fixed values).
CASE_ENDINGS = ("", "А", "Я", "У", "Ю", "Е", "Ы", "И", "О", "ОМ", "ЕМ", "ЁМ", "ОВ", "ЕВ", "АМ", "ЯМ", "АМИ", "ЯМИ", "АХ", "ЯХ", "ОЙ", "ЕЙ", "ОЮ", "ЕЮ", "Ь", "Й")
VOWELS = "аеёиоуыэюяАЕЁИОУЫЭЮЯ"
YES, NO = ("on", "true", "1", "yes", "да"), ("off", "false", "0", "no", "нет")


def html_escape(s: Column) -> Column:
    out = F.replace(s, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def attr_escape(s: Column) -> Column:
    return F.replace(html_escape(s), F.lit('"'), F.lit("&quot;"))


def field_escape(s: Column, separator: str = "|") -> Column:
    return F.replace(s, F.lit(separator), F.lit("\\" + separator))


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substring(s, 2, 1 << 30)))


def fold_upper(s: Column) -> Column:
    """Upper case with the letter yo taken as ye."""
    return F.translate(F.upper(s), "Ё", "Е")


def oblique_stem(base: Column) -> Column:
    """The stem of a folded nominative: two fleeting vowels, a soft ending dropped."""
    return (
        F.when(base == "ТВОРЕЦ", "ТВОРЦ").when(base == "ОРЕЛ", "ОРЛ").when(F.right(base, F.lit(1)).isin("Ь", "Й", "А", "Я"), F.left(base, F.length(base) - 1)).otherwise(base)
    )


def plural(n: Column, one: str, few: str, many: str) -> Column:
    tens, hundreds = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    return F.when((tens == 1) & (hundreds != 11), one).when(tens.between(2, 4) & ~hundreds.between(12, 14), few).otherwise(many)


def truthy(s: Column) -> Column:
    return F.lower(F.trim(F.coalesce(s, F.lit("")))).isin(*YES)


def falsy(s: Column) -> Column:
    return F.lower(F.trim(F.coalesce(s, F.lit("")))).isin(*NO)


def video_id(url: Column, wide: bool = False) -> Column:
    """The 11-character video id of a URL, or null.  ``wide`` knows thumbnails and watch links too."""
    more = r"|/vi/|watch\?v=" if wide else ""
    return F.nullif(F.regexp_extract(url, rf"(?:v=|youtu\.be/|youtube\.com/embed/{more})([A-Za-z0-9_-]{{11}})", 1), F.lit(""))


def url_plain(url: Column) -> Column:
    """Lower case, https, no closing slashes."""
    return F.replace(F.regexp_replace(F.lower(F.trim(url)), "/+$", ""), F.lit("http://"), F.lit("https://"))


def url_bare(url: Column) -> Column:
    """Without scheme, www or m, query, fragment and closing slashes."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "^https?://", ""), r"^(www\.|m\.)", "")
    return F.regexp_replace(F.substring_index(F.substring_index(s, "?", 1), "#", 1), "/+$", "")


def url_https(url: Column) -> Column:
    """https and no closing slashes; the case stays."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), "(?i)^http://", "https://")


#: A note marker (fixed pattern of the markup).
_MARKS = r"\[\^[^\]]+\]"


#: What doesn't count in a title, in the order in which it goes: note marks, brackets, punctuation (fixed patterns).
TITLE_NOISE = (_MARKS, r"\([^)]*\)", "[«»\"'`.,!?:·…—–-]+")


def title_words(s: Column) -> Column:
    """Lower case, no note marks, brackets or punctuation, single spaces."""
    s = F.replace(F.lower(F.coalesce(s, F.lit(""))), F.lit("ё"), F.lit("е"))
    for noise in TITLE_NOISE:
        s = F.regexp_replace(s, noise, " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def title_key(s: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.replace(F.lower(F.coalesce(s, F.lit(""))), F.lit("ё"), F.lit("е")), "[^0-9a-zа-я]+", "")


def title_spaced(s: Column) -> Column:
    """Letters and digits, runs of anything else as one space."""
    s = F.replace(F.lower(F.coalesce(s, F.lit(""))), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^0-9a-zа-я ]+", " "), r"\s+", " "))


def quote_words(s: Column) -> Column:
    """A quotation without its number, opening lemma, quote marks and punctuation."""
    s = F.regexp_replace(s, r"^\s*\d+\)\s*", "")
    s = F.regexp_replace(s, r"^.{0,80}?и\s*т\.?\s*д\.?\s*:\s*", "")
    s = F.regexp_replace(F.regexp_replace(s, "[«»„“”\"'`]", ""), r"(?U)[^\w\s]", " ")
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def strip_marks(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), _MARKS, ""))


def marks(s: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(f"({_MARKS})"), F.lit(1))


def file_stem(s: Column) -> Column:
    """Anything but letters and digits as one underscore."""
    return F.regexp_replace(s, "[^A-Za-z0-9]+", "_")


def last_segment(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]+)$", 1)


def page_url(path: Column) -> Column:
    """index.html stands for its directory."""
    return F.regexp_replace(path, "(^|/)index\\.html$", "$1")


def soft_truncate(s: Column, most: int = 160, slack: int = 10) -> Column:
    """Beyond ``most + slack`` characters cut at the last space within ``most``."""
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    cut = F.left(s, F.lit(most))
    cut = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(s) > most + slack, F.regexp_replace(cut, "[ ,.;—-]+$", "")).otherwise(s)


#: Words after which a double colon is a colon (fixed values).
_COLON_WORDS = "См\\.\\s*также|Цитата|Музыка|Источник|Автор|Примечание|Дополнение|Параллели|Заповедь|Том|Глава|Книга|Сноска"


def double_colon(s: Column) -> Column:
    """``::`` after a marker word is a colon, elsewhere a dash."""
    s = F.regexp_replace(s, rf"(?iu)({_COLON_WORDS})\s*::\s*", "$1: ")
    return F.regexp_replace(s, r"\s*::\s*", " — ")


def base64_url(s: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.encode(s, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def from_base64_url(s: Column) -> Column:
    padded = F.rpad(F.translate(s, "-_", "+/"), (F.ceil(F.length(s) / 4) * 4).cast("int"), F.lit("="))
    return F.decode(F.unbase64(padded), "UTF-8")


def strip_set(s: Column, chars: str) -> Column:
    return F.btrim(s, F.lit(chars))


def syllables(token: Column) -> Column:
    return F.length(F.regexp_replace(token, f"[^{VOWELS}]", ""))


def star(s: Column) -> Column:
    return F.translate(s, "★✱＊", "***")


def fnv1a(s: Column) -> Column:
    """FNV-1a (32 bits) over code points below 65536, as 8 hex digits."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda a, c: (a.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def caps_ratio(s: Column) -> Column:
    """Upper-case share of letters, to two places; 0 without letters."""
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    return F.when(letters == 0, 0.0).otherwise(F.round(upper / letters, 2))


def caps_line(s: Column) -> Column:
    """At least three Cyrillic letters, of which 70 % or more in capitals; tags don't count."""
    bare = F.regexp_replace(s, "<[^>]+>", "")
    letters = F.length(F.regexp_replace(bare, "[^А-Яа-яЁё]", ""))
    return (letters >= 3) & (F.length(F.regexp_replace(bare, "[^А-ЯЁ]", "")) >= 0.7 * letters)


def slug(s: Column, default: str = "section") -> Column:
    """The first three words of what is left without punctuation, joined by a dash."""
    bare = F.regexp_replace(s, "[^А-Яа-яA-Za-z0-9 -]", "")
    words = F.slice(F.filter(F.split(bare, r"\s+"), lambda w: w != ""), 1, 3)
    out = F.array_join(F.transform(words, F.lower), "-")
    return F.when(out == "", default).otherwise(out)


def split_escaped(s: Column, separator: str = "|") -> Column:
    """Split at separators without a backslash before them; the backslash goes."""
    parts = F.split(s, rf"(?<!\\)\{separator}", -1)
    return F.transform(parts, lambda x: F.replace(x, F.lit("\\" + separator), F.lit(separator)))


def newlines(s: Column) -> Column:
    return F.regexp_replace(s, "\r\n?", "\n")


def plain_text(html: Column) -> Column:
    """Tags away, breaks as line feeds, common entities decoded."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[ \t]+", " "), r" *\n\s*", "\n"))


def visible_chars(s: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", ""))


def stem_overlap(a: Column, b: Column, size: int = 5, least: int = 3) -> Column:
    """Share of a's words whose first ``size`` letters begin a word of b."""
    words = lambda s: F.filter(F.split(title_spaced(s), " "), lambda w: F.length(w) >= least)
    stems = lambda s: F.transform(words(s), lambda w: F.left(w, F.lit(size)))
    n = F.size(words(a))
    hit = F.size(F.filter(stems(a), lambda w: F.array_contains(stems(b), w)))
    return F.when(n == 0, 0.0).otherwise(hit / n)

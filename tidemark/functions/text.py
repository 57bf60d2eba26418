"""Text columns: normal forms, URLs, HTML, headlines, ids, tokens. All are built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters with these beginnings only track a visitor.
TRACKING_PREFIXES = ("utm_", "fbclid", "gclid", "cmpid", "output", "ref", "refsrc")
#: Words that do not tell headlines apart.
COMMON_HEADLINE_WORDS = (
    "the", "a", "an", "and", "or", "to", "for", "of", "on", "in", "with", "news", "rumor", "rumors", "rumour", "rumours",
    "transfer", "transfers", "deal", "deals", "move", "moves", "sign", "signs", "signing", "bid", "bids", "update", "updates",
    "report", "reports", "star", "latest", "live",
)
#: Words without weight in searches.
STOP_WORDS = (
    "a", "about", "also", "an", "and", "are", "as", "at", "be", "by", "can", "club", "do", "does", "for", "from", "has", "have",
    "how", "in", "is", "it", "me", "of", "on", "or", "show", "stock", "the", "this", "to", "transfer", "what", "with",
)



def _foldings() -> tuple[str, str, dict[str, str]]:
    """From the Unicode tables: characters whose compatibility decomposition, without combining marks, is one other character,
    that character, and those that become several ASCII characters."""
    single, several = {}, {}
    for i in range(128, 0x20000):
        char = chr(i)
        if 0xD800 <= i <= 0xDFFF or unicodedata.combining(char):
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain != char and plain.isascii() and any(c.isalnum() for c in plain):
            (single if len(plain) == 1 else several)[char] = plain
    return "".join(single), "".join(single.values()), several


_ACCENTED, _PLAIN, _SPELLED = _foldings()
#: Letters of Latin that decompose into two: ligatures and digraphs.
_LIGATURES = {k: v for k, v in _SPELLED.items() if len(v) <= 3 and v.isalpha() and unicodedata.category(k) in ("Ll", "Lu", "Lt")}


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def alnum_folded(c: Column) -> Column:
    """Accents off (compatibility decomposition, combining marks dropped), lower case, all but a-z and 0-9 to single spaces.
    Letters that do not decompose, such as o with a stroke, become spaces."""
    bare = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), r"\p{M}+", ""), _ACCENTED, _PLAIN)
    for char, plain in _LIGATURES.items():
        bare = F.replace(bare, F.lit(char), F.lit(plain))
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def alnum_unicode(c: Column) -> Column:
    """Lower case, all but letters and digits of any script to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def alnum_ascii(c: Column) -> Column:
    """Lower case without folding, all but a-z and 0-9 to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.replace(alnum_ascii(c), F.lit(" "), F.lit("-"))


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking and empty parameters, and trailing slashes of the path."""
    whole = F.trim(url)
    head, query = F.substring_index(F.substring_index(whole, "#", 1), "?", 1), F.regexp_extract(F.substring_index(whole, "#", 1), r"\?(.*)$", 1)
    tracks = lambda kv: F.lower(kv).rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")
    kept = F.filter(F.split(query, "&"), lambda kv: kv.rlike("=.") & ~tracks(kv))
    origin, path = F.regexp_extract(head, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1), F.regexp_replace(head, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    trimmed = F.regexp_replace(path, "/+$", "")
    return F.concat(origin, F.when(trimmed == "", "/").otherwise(trimmed), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


#: Entities that are turned back, the ampersand last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def strip_html(html: Column) -> Column:
    """Visible text: script, style and noscript blocks and all tags go, common entities are turned back."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze(c)


def main_text(html: Column, least: int = 250, most: int | None = None) -> Column:
    """Text of the first article, main or body block with at least `least` characters, else of the whole page; whole, or its
    first `most` characters."""
    blocks = [strip_html(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1)) for t in ("article", "main", "body")]
    found = F.coalesce(*(F.when(F.char_length(x) >= least, x) for x in blocks), strip_html(html))
    return found if most is None else F.left(found, F.lit(most))


def page_title(html: Column) -> Column:
    return strip_html(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))


def headline(title: Column) -> Column:
    """Title without its last ` - Publisher` part."""
    return squeeze(F.regexp_replace(F.coalesce(title, F.lit("")), r"^(.*) - .*$", "$1"))


def publisher_suffix(title: Column) -> Column:
    """What stands behind the last ` - `, if it has 1 to 80 characters; else empty."""
    tail = F.trim(F.regexp_extract(F.coalesce(title, F.lit("")), r"^.* - (.*)$", 1))
    return F.when(F.char_length(tail) <= 80, tail).otherwise("")


def publisher(source: Column, title: Column, snippet: Column | None = None) -> Column:
    """Publisher of a row, looking behind aggregator feeds."""
    own = F.trim(F.substring_index(F.coalesce(source, F.lit("")), " / ", 1))
    font = F.trim(F.regexp_extract(F.coalesce(snippet, F.lit("")), r"(?i)<font[^>]*>([^<]+)</font>", 1)) if snippet is not None else F.lit("")
    found = F.coalesce(F.nullif(publisher_suffix(title), F.lit("")), F.nullif(font, F.lit("")))
    return F.when(F.lower(own).startswith("google news"), F.coalesce(found, own)).otherwise(F.coalesce(F.nullif(own, F.lit("")), F.nullif(publisher_suffix(title), F.lit("")), F.lit("Unknown")))


def fingerprint(title: Column, most: int = 10) -> Column:
    """The first telling words of a headline; all its words if none tells."""
    norm = F.trim(F.regexp_replace(F.lower(headline(title)), "[^a-z0-9]+", " "))
    telling = F.filter(F.split(norm, " "), lambda w: (w != "") & ~w.isin(*COMMON_HEADLINE_WORDS))
    return F.when(F.size(telling) > 0, F.array_join(F.slice(telling, 1, most), " ")).otherwise(norm)


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case search tokens in order, without stop words and short ones."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9][a-z0-9_'-]*)"), F.lit(1))
    bare = F.transform(found, lambda t: F.btrim(t, F.lit("'")))
    return F.filter(bare, lambda t: (F.char_length(t) >= least) & ~t.isin(*STOP_WORDS))


def trigrams(text: Column, n: int = 3) -> Column:
    """Character n-grams of the squeezed, padded lower-case text, repeats included; none for an empty text."""
    norm = squeeze(F.lower(F.coalesce(text, F.lit(""))))
    padded = F.concat(F.lit("  "), norm, F.lit("  "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, n))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(grams)


def surname(name: Column) -> Column:
    return F.element_at(F.split(alnum_unicode(name), " "), -1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the words of two names; 0 if one has none."""
    x, y = (F.array_distinct(F.filter(F.split(alnum_unicode(c), " "), lambda w: w != "")) for c in (a, b))
    both = F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / both).otherwise(0.0)


def parse_list(c: Column) -> Column:
    """A list from a JSON array, a `|` list, a `,` list or a single value."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    parts = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.contains("|"), F.split(raw, r"\|")).otherwise(F.split(raw, ","))
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def reporter(journalist: Column, source: Column) -> Column:
    """Explicit name, else what follows ` / ` or ` by ` in the source."""
    slash, by = F.regexp_extract(source, r"^.*? / (.*)$", 1), F.regexp_extract(source, r"(?i)^.*? by (.*)$", 1)
    return F.coalesce(*(F.nullif(squeeze(x), F.lit("")) for x in (journalist, slash, by)), F.lit(""))


def source_name(source: Column, provider: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(squeeze(source), F.lit("")), F.nullif(squeeze(provider), F.lit("")), F.lower(F.parse_url(url, F.lit("HOST"))))


def stable_id(*parts: Column) -> Column:
    """16 hex digits of the parts."""
    return F.left(F.sha1(F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), F.lit(16))


def snippet(text: Column, found: Column, width: int = 260, before: int = 80) -> Column:
    """The text around the first of the tokens `found`, with dots where it goes on."""
    places = F.filter(F.transform(found, lambda t: F.locate(t, F.lower(text)) if isinstance(t, str) else F.instr(F.lower(text), t)), lambda p: p > 0)
    start = F.when(F.size(places) > 0, F.greatest(F.lit(0), F.array_min(places) - 1 - before)).otherwise(0)
    body = F.trim(F.substring(text, start + 1, F.lit(width)))
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + width < F.char_length(text), "...").otherwise(""))


#: Words of which one at least is in a story about transfers.
STORY_WORDS = (
    "transfer", "signing", "sign", "signed", "agreement", "agree", "agreed", "talks", "bid", "bids", "deal", "clause", "medical",
    "join", "joins", "move", "moves", "sell", "sale", "buy", "loan", "future", "contract", "exit",
)
#: Texts about matches.
MATCH_STORIES = ("as it happened", "match report", "minute by minute", "live updates", "live blog", "preview", "player ratings")


def is_transfer_story(text: Column, words: tuple[str, ...] = STORY_WORDS) -> Column:
    """One of the words is there, and no phrase of match stories is."""
    norm = alnum_ascii(text)
    return F.arrays_overlap(F.split(norm, " "), F.array(*map(F.lit, words))) & ~norm.rlike("|".join(MATCH_STORIES))


def club_labels(clubs: Column) -> Column:
    """Clubs (an array of name and aliases) with their labels as `named_clubs` compares them; computed once where clubs are fixed."""
    norm = lambda label: F.concat(F.lit(" "), squeeze(F.lower(label)), F.lit(" "))
    labels = lambda c: F.filter(F.transform(F.concat(F.array(c["name"]), F.coalesce(c["aliases"], F.array().cast("array<string>"))), norm), lambda x: F.trim(x) != "")
    return F.transform(clubs, lambda c: F.struct(c["name"].alias("name"), labels(c).alias("labels")))


def named_clubs(text: Column, clubs: Column, labelled: bool = False) -> Column:
    """Names of the clubs (an array of name and aliases, or what `club_labels` made of it if `labelled`) that stand in the text with
    spaces around them, in their order. The text is brought to its normal form once, not once for each club."""
    inside = F.concat(F.lit(" "), squeeze(F.lower(F.coalesce(text, F.lit("")))), F.lit(" "))
    known = clubs if labelled else club_labels(clubs)
    found = lambda x: F.array_distinct(F.transform(F.filter(known, lambda c: F.exists(c["labels"], lambda w: F.contains(x, w))), lambda c: c["name"]))
    return F.get(F.transform(F.array(inside), found), F.lit(0))


def day_of(c: Column) -> Column:
    """yyyy-MM-dd at the start of a text, else the date it parses to, else its first ten characters; blank for no text."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    parsed = F.date_format(F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z")), "yyyy-MM-dd")
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(raw, F.lit(10))).otherwise(F.coalesce(parsed, F.left(raw, F.lit(10))))

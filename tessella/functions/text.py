"""Text functions as native columns: bigrams, assembly, tokens, similarity."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code point ranges whose runs are cut into bigrams.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
#: What replaces an image, and what heads the comments.
IMAGE_MARK, DISCUSSION_HEAD = "[图片]", "\n\n[讨论]\n"
#: Fixed value: an embedded image, or a bare address of an image file.
IMAGE = r'!\[[^\]\n]*\]\([^)\n]*\)|http(?=[^ \n\r)"\t]*\.(?i:png|jpe?g|gif|webp|bmp))[^ \n\r)"\t]*'
#: Defaults of the text that is embedded.
TITLE_REPEATS, BODY_MAX, COMMENT_QUOTA, PER_COMMENT_MAX, SNIPPET_CHARS = 2, 2000, 3000, 500, 200
TOKEN = r"[\p{L}\p{N}]+"


def _folding() -> tuple[str, str]:
    """Latin letters with diacritics, and the letters without: those that decompose into one letter and marks."""
    pairs = []
    for code in range(0xC0, 0x250):
        base, *marks = unicodedata.normalize("NFD", chr(code).lower())
        if marks and base.isalpha() and all(unicodedata.combining(m) for m in marks) and chr(code) == chr(code).lower():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def trimmed(c: Column) -> Column:
    """Without white space at the ends, by Unicode's definition."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cjk_bigram(c: Column) -> Column:
    """Each run of CJK characters as overlapping bigrams, separated by spaces; other text stays, without the space around it.

    Each step puts spaces at one kind of border, so no look-behind over characters beyond the
    basic plane is needed.
    """
    out = F.regexp_replace(c, rf"(?U)([{CJK}])\s*(?=[^{CJK}\s])", "$1 ")
    out = F.regexp_replace(out, rf"(?U)([^{CJK}\s])\s*(?=[{CJK}])", "$1 ")
    out = F.regexp_replace(out, rf"(?U)([{CJK}])\s+(?=[{CJK}])", "$1 ")
    out = F.regexp_replace(out, rf"([{CJK}])(?=([{CJK}]))", "$1$2 ")
    out = F.regexp_replace(out, rf"([{CJK}]{{2}}) ([{CJK}])(?![{CJK}])", "$1")
    return F.when(c.rlike(f"[{CJK}]"), trimmed(out)).otherwise(trimmed(c))


def strip_image_links(c: Column) -> Column:
    return F.regexp_replace(c, IMAGE, IMAGE_MARK)


def title_block(title: Column, repeats: int = TITLE_REPEATS) -> Column:
    return F.repeat(F.concat(trimmed(F.coalesce(title, F.lit(""))), F.lit("\n")), repeats)


def build_text(title: Column, body: Column, repeats: int = TITLE_REPEATS, body_max: int = BODY_MAX) -> Column:
    """The title's lines, then the body's first characters; the body isn't trimmed."""
    return F.concat(title_block(title, repeats), F.substring(F.coalesce(body, F.lit("")), 1, body_max))


def without_bots(comments: Column) -> Column:
    return F.filter(comments, lambda c: ~F.coalesce(c["author"].endswith("[bot]"), F.lit(False)))


def build_text_with_comments(
    title: Column, body: Column, comments: Column, repeats: int = TITLE_REPEATS, body_max: int = BODY_MAX, quota: int = COMMENT_QUOTA, per_comment: int = PER_COMMENT_MAX
) -> Column:
    """Title, body without images, and comments up to a quota of characters.

    Images go before the body is cut. The lines are cut as one string, which equals stopping at
    the line that fills the quota.
    """
    body = F.substring(strip_image_links(F.coalesce(body, F.lit(""))), 1, body_max)
    line = lambda c: F.concat(F.lit("- "), F.coalesce(c["author"], F.lit("")), F.lit(" "), F.substring(F.coalesce(c["body"], F.lit("")), 1, per_comment), F.lit("\n"))
    lines = F.substring(F.array_join(F.transform(comments, line), ""), 1, quota)
    talk = F.when(F.coalesce(F.size(comments), F.lit(0)) > 0, F.concat(F.lit(DISCUSSION_HEAD), lines)).otherwise("")
    return F.concat(title_block(title, repeats), body, talk)


def text_hash(title: Column, body: Column, comments: Column, **params) -> Column:
    """SHA-1 of the embedded text, which leaves bots' comments out."""
    return F.sha1(build_text_with_comments(title, body, without_bots(comments), **params).cast("binary"))


def tokens(c: Column) -> Column:
    """Index tokens: runs of letters and digits, in lower case, without diacritics; CJK runs as bigrams."""
    folded = F.regexp_replace(F.translate(F.lower(cjk_bigram(F.coalesce(c, F.lit("")))), ACCENTED, PLAIN), r"\p{M}", "")
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def py_cjk_bigram(text: str) -> str:
    """cjk_bigram for a driver-side string, as a query is."""
    import regex

    ranges = regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m.group(1), 16)), CJK)
    out = []
    for part in regex.findall(rf"[{ranges}]+|[^{ranges}]+", text):
        if regex.match(f"[{ranges}]", part):
            out.append(" ".join(part[k : k + 2] for k in range(max(1, len(part) - 1))))
        elif part.strip():
            out.append(part.strip())
    return " ".join(out)


def py_phrases(query: str) -> list[list[str]]:
    """The phrases of a query: each word's tokens must stand side by side; words without tokens are left out."""
    import regex

    fold = str.maketrans(ACCENTED, PLAIN)
    words = py_cjk_bigram(query).split()
    made = [regex.findall(TOKEN, regex.sub(r"\p{M}", "", w.lower().translate(fold))) for w in words]
    return [m for m in made if m]


def snippet(body: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.substring(trimmed(F.coalesce(body, F.lit(""))), 1, chars)


def title_tokens(c: Column) -> Column:
    """Tokens for title similarity: split at white space, punctuation kept."""
    return F.filter(F.split(cjk_bigram(F.lower(F.coalesce(c, F.lit("")))), r"(?U)\s+"), lambda t: t != "")


def title_similarity(a: Column, b: Column) -> Column:
    """Dice's coefficient over multisets of title tokens; 0 where either is empty."""
    ta, tb = title_tokens(a), title_tokens(b)
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    shared = F.aggregate(F.array_distinct(ta), F.lit(0), lambda acc, t: acc + F.least(count(ta, t), count(tb, t)))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(2.0 * shared / (F.size(ta) + F.size(tb)))


def repo_dir_name(repo: str) -> str:
    return repo.replace("/", "__")

"""URL splitting, resolution, normalisation, filters and slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import let, non_empty

# RFC 3986, appendix B, with a well-formed scheme.
URL = (
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
    r"([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"
)

# --- fixed values -----------------------------------------------------------
SKIPPED_HREF_PREFIXES = ("#", "javascript:", "mailto:", "tel:")
PAGE_SCHEMES = ("http", "https")
NON_PAGE_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "svg", "pdf", "zip", "tar", "gz", "css", "js", "xml",
)
SLUG_LENGTH = 100
EMPTY_SLUG = "page"
# ----------------------------------------------------------------------------


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, URL, 2)


def path(url: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, URL, 3), ";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, URL, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, URL, 5)


def normalise(url: Column) -> Column:
    """Identity of a page: scheme, host and path; query and fragment do not count."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    return F.concat(
        scheme(url),
        F.lit("://"),
        netloc(url),
        F.coalesce(non_empty(trimmed), F.lit("/")),
    )


def _remove_dot_segments(p: Column) -> Column:
    folded = F.aggregate(
        F.split(p, "/", -1),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, seg)),
    )
    closed = F.when(p.rlike(r"(?:^|/)\.{1,2}$"), F.array_append(folded, F.lit(""))).otherwise(
        folded
    )
    joined = F.array_join(closed, "/")
    rooted = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(p.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), rooted).otherwise(p)


def _suffix(mark: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(mark), value)).otherwise("")


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` found on the page ``base``."""
    ref = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]++", ""), r"[\t\r\n]", "")
    return let(ref, lambda r: _resolve(base, r))


def _resolve(base: Column, r: Column) -> Column:
    own_scheme = scheme(r)
    other_scheme = (own_scheme != "") & (own_scheme != scheme(base))
    raw_path = F.regexp_extract(r, URL, 3)
    base_path = F.regexp_extract(base, URL, 3)
    base_dir = F.regexp_replace(base_path, "[^/]*$", "")
    merged = F.regexp_replace(
        F.concat(F.coalesce(non_empty(base_dir), F.lit("/")), raw_path), "/{2,}", "/"
    )
    own_query, own_fragment = query(r), fragment(r)
    relative = (
        F.when(
            raw_path == "",
            F.concat(
                base_path,
                _suffix(
                    "?", F.when(own_query != "", own_query).otherwise(query(base))
                ),
            ),
        )
        .when(
            raw_path.startswith("/"),
            F.concat(_remove_dot_segments(raw_path), _suffix("?", own_query)),
        )
        .otherwise(F.concat(_remove_dot_segments(merged), _suffix("?", own_query)))
    )
    return (
        F.when(r == "", base)
        .when(other_scheme, r)
        .when(r.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]"),
              F.concat(scheme(base), F.lit("://"), F.regexp_replace(r, "^[^/]*//", "")))
        .otherwise(
            F.concat(
                scheme(base),
                F.lit("://"),
                netloc(base),
                relative,
                _suffix("#", own_fragment),
            )
        )
    )


def is_followable_href(href: Column) -> Column:
    """False for in-page, script, mail and phone links; an empty href passes."""
    return ~href.rlike(f"^(?:{'|'.join(SKIPPED_HREF_PREFIXES)})")


def is_page_scheme(url: Column) -> Column:
    return scheme(url).isin(*PAGE_SCHEMES)


def is_page_path(url: Column) -> Column:
    """False for a path that ends in a known non-page extension."""
    return ~path(url).rlike(rf"(?i)\.(?:{'|'.join(NON_PAGE_EXTENSIONS)})$")


def glob_to_regex(pattern: str) -> str:
    """Java regex for a shell glob; ``*`` also crosses '/'."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!")) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end]
            negated = body.startswith("!")
            body = body[1:] if negated else body
            for special in ("\\", "[", "^", "&"):
                body = body.replace(special, "\\" + special)
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        else:
            out.append(ch if ch.isalnum() or ch in "/_" else "\\" + ch)
        i += 1
    return rf"(?s)\A{''.join(out)}\z"


def matches_glob(url: Column, pattern: str) -> Column:
    return url.rlike(glob_to_regex(pattern))


def slug(url: Column) -> Column:
    """File-name-safe page name; different URLs may share one."""
    words = F.regexp_replace(F.concat(netloc(url), path(url)), "[^a-zA-Z0-9]+", "_")
    short = F.left(F.regexp_replace(words, "^_|_$", ""), F.lit(SLUG_LENGTH))
    return F.coalesce(non_empty(short), F.lit(EMPTY_SLUG))

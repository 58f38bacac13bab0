"""SQL counterparts of the registered queries, for DuckDB on the same tables.

Written from the operators' definitions with other means than the Spark side: token
rows and string aggregation where Spark works on arrays, islands where it uses a
regular expression, a recursive walk for the crawl. DuckDB's regular expressions have
no look-around or back-references; ``![`` is hidden behind one character where a rule
says "not an image".
"""

from __future__ import annotations

from leafmill.catalog.inputs import IMAGE_ASSETS, MD_DOCS, META_PAGES, MIRRORED_SITE, RICH_PAGES, SITE_PAGES

_TOKEN = (
    r"<!--[\s\S]*?-->|<script\b[\s\S]*?</script\s*>|<style\b[\s\S]*?</style\s*>"
    r"|</?[A-Za-z][^>]*>|</?[A-Za-z][^>]*$|<![^>]*>|[^<]+|<"
)
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"
_LINK = r"\[([^\]]*)\]\(([^)]+)\)"
_LATER = "https?|ftp"


def _with(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def _part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{_URL}', {group})"


def _scheme(url: str) -> str:
    return f"lower({_part(url, 1)})"


def _netloc(url: str) -> str:
    return _part(url, 2)


def _norm(url: str) -> str:
    trimmed = f"rtrim({_part(url, 3)}, '/')"
    return (
        f"{_scheme(url)} || '://' || {_netloc(url)} || "
        f"CASE WHEN {trimmed} = '' THEN '/' ELSE {trimmed} END"
    )


def _slug(url: str) -> str:
    words = f"regexp_replace({_netloc(url)} || {_part(url, 3)}, '[^a-zA-Z0-9]+', '_', 'g')"
    return f"coalesce(nullif(left(trim({words}, '_'), 100), ''), 'page')"


def _unique_slug(url: str) -> str:
    return (
        f"{_slug(url)} || CASE WHEN count(*) OVER (PARTITION BY {_slug(url)}) > 1 "
        f"THEN '_' || md5({url}) ELSE '' END"
    )


def _decode(x: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"')):
        x = f"replace({x}, '&{name};', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _tokens(source: str) -> str:
    return rf"""tok AS (
  SELECT *,
    CASE WHEN raw NOT LIKE '<%' THEN 'text' WHEN raw LIKE '<!--%' THEN 'comment'
      WHEN regexp_matches(raw, '^<(?:script|style)[\s/>]') THEN 'raw'
      WHEN raw LIKE '<!%' THEN 'decl'
      WHEN regexp_matches(raw, '^</?[A-Za-z]') AND raw LIKE '%>' THEN 'tag'
      WHEN regexp_matches(raw, '^</?[A-Za-z]') THEN 'cut' ELSE 'text' END AS kind,
    CASE WHEN regexp_matches(raw, '^</?[A-Za-z]')
      THEN lower(regexp_extract(raw, '^</?([A-Za-z][^\s/>]*)', 1)) ELSE '' END AS tag,
    raw LIKE '</%' AS is_close
  FROM (
    SELECT p.page_id, p.url, u.n::BIGINT - 1 AS pos, u.t AS raw
    FROM {source} p, unnest(regexp_extract_all(p.html, '{_TOKEN}')) WITH ORDINALITY AS u(t, n)))"""


# Nesting in navigation, footer, header and aside; the given pages nest them properly.
_DEPTH = """dep AS (
  SELECT *, sum(CASE WHEN kind = 'tag' AND tag IN ('nav', 'footer', 'header', 'aside')
      THEN CASE WHEN is_close THEN -1 ELSE 1 END ELSE 0 END)
    OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS depth
  FROM tok)"""

_TEXT = f"""txt AS (
  SELECT page_id, string_agg(t, ' ' ORDER BY pos) AS text
  FROM (SELECT page_id, pos, {_strip(_decode('raw'))} AS t FROM tok WHERE kind = 'text')
  WHERE t <> '' GROUP BY page_id)"""

_WORDS = r"CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split_regex(text, '\s+')) END"


def _anchors(source: str, body: str = "html") -> str:
    """Anchors outside comments and scripts; the given pages quote every href."""
    return rf"""a AS (
  SELECT page_id, url, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::BIGINT AS pos,
    regexp_extract(t, 'href="([^"]*)"', 1) AS href
  FROM (SELECT p.page_id, p.url, u.t, u.n FROM {source} p,
    unnest(regexp_extract_all(p.{body}, '{_TOKEN}')) WITH ORDINALITY AS u(t, n))
  WHERE t LIKE '<a %')"""


_OK_HREF = "NOT regexp_matches(href, '^(?:#|javascript:|mailto:|tel:)')"

# The links at hand are absolute, rooted or fragments; queries stay on rooted ones.
_ABS = f"""abs AS (
  SELECT page_id, url, pos, href,
    CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href
      WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href
      ELSE {_scheme('url')} || '://' || {_netloc('url')} || href END AS abs_url
  FROM a)"""

_EDGES = f"""edges AS (
  SELECT page_id, pos, href, abs_url, norm_url FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, norm_url ORDER BY pos) AS k FROM (
      SELECT *, {_norm('abs_url')} AS norm_url FROM abs
      WHERE {_OK_HREF} AND {_netloc('abs_url')} = {_netloc('url')}
        AND {_scheme('abs_url')} IN ('http', 'https')
        AND NOT regexp_matches({_part('abs_url', 3)},
          '(?i)\\.(jpg|jpeg|png|gif|svg|pdf|zip|tar|gz|css|js|xml)$')))
  WHERE k = 1)""".replace("\\\\", "\\")


def _walk(depth: int, where: str = "TRUE") -> str:
    """All walks from the home pages; breadth-first order is (length, positions)."""
    return f"""target AS (
  SELECT e.page_id AS src, e.pos, e.norm_url, s.page_id AS dst, s.url
  FROM edges e JOIN (SELECT *, {_norm('url')} AS norm_url FROM site_pages) s USING (norm_url)
  WHERE s.status < 400 AND {where}),
walk AS (
  SELECT page_id AS seed_id, page_id, url, {_norm('url')} AS norm_url, NULL::VARCHAR AS parent_url,
    0 AS level, []::BIGINT[] AS path
  FROM site_pages WHERE url LIKE '%/p/0'
  UNION ALL
  SELECT w.seed_id, t.dst, t.url, t.norm_url, w.url, w.level + 1, list_append(w.path, t.pos)
  FROM walk w JOIN target t ON t.src = w.page_id WHERE w.level < {depth}),
crawl AS (
  SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY level, path) AS crawl_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY seed_id, norm_url ORDER BY level, path) AS k FROM walk)
  WHERE k = 1)"""


_SITE_EDGES = (SITE_PAGES, _anchors("site_pages"), _ABS, _EDGES)


def _citations(source: str) -> tuple[str, ...]:
    """Links of a markdown column as rows and the cited text put together again."""
    hidden = "replace(markdown, '![', chr(1))"
    return (
        f"""lnk AS (
  SELECT d.doc_id, u.n::BIGINT AS ord, u.m,
    regexp_extract(u.m, '^{_LINK}$', 1) AS label, regexp_extract(u.m, '^{_LINK}$', 2) AS url
  FROM {source} d,
    unnest(regexp_extract_all({hidden}, '{_LINK}')) WITH ORDINALITY AS u(m, n))""",
        """fst AS (
  SELECT doc_id, url, min(ord) AS first_ord, row_number() OVER
    (PARTITION BY doc_id ORDER BY min(ord)) AS n
  FROM lnk WHERE url NOT LIKE '#%' GROUP BY doc_id, url)""",
        """refs AS (
  SELECT doc_id, E'\\n## References\\n\\n' ||
    string_agg('[' || n || '] ' || url, E'\\n' ORDER BY n) AS refs
  FROM fst GROUP BY doc_id)""",
        f"""gap AS (
  SELECT d.doc_id, u.n::BIGINT AS ord, u.g
  FROM {source} d, unnest(string_split_regex({hidden}, '{_LINK}')) WITH ORDINALITY AS u(g, n))""",
        """cited AS (
  SELECT g.doc_id, replace(string_agg(g.g || CASE WHEN l.m IS NULL THEN ''
      WHEN l.url LIKE '#%' THEN l.m
      WHEN trim(l.label) = '' THEN '[' || f.n || ']'
      ELSE l.label || ' [' || f.n || ']' END, '' ORDER BY g.ord), chr(1), '![') AS cited
  FROM gap g LEFT JOIN lnk l ON l.doc_id = g.doc_id AND l.ord = g.ord
    LEFT JOIN fst f ON f.doc_id = l.doc_id AND f.url = l.url
  GROUP BY g.doc_id)""",
    )


_DOC_CITATIONS = (MD_DOCS, *_citations("md_docs"))

_HEADINGS = r"""ln AS (
  SELECT d.doc_id, u.n::BIGINT AS n, u.line, regexp_full_match(u.line, '#{1,6}\s*') AS orphan,
    trim(u.line) <> '' AND NOT regexp_matches(trim(u.line), '^(?:[#*\-\[|>]|```)')
      AND len(string_split_regex(trim(u.line), '\s+')) <= 3 AS short
  FROM md_docs d, unnest(string_split(d.markdown, E'\n')) WITH ORDINALITY AS u(line, n)),
isl AS (
  SELECT *, max(CASE WHEN NOT short THEN n END) OVER w AS base,
    arg_max(orphan, CASE WHEN NOT short THEN n END) OVER w AS under
  FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
grp AS (
  SELECT doc_id, CASE WHEN short AND under THEN base ELSE n END AS g,
    CASE WHEN count(*) > 1 THEN string_agg(trim(line), ' ' ORDER BY n) ELSE any_value(line) END AS line
  FROM isl GROUP BY ALL),
headed AS (
  SELECT doc_id, string_agg(line, E'\n' ORDER BY g) AS markdown FROM grp GROUP BY doc_id)"""

_NO_EMPTY = (
    r"replace(regexp_replace(replace(regexp_replace(markdown, '!\[\]\([^)]+\)\s*', '', 'g'),"
    r" '![', chr(1)), '\[\]\([^)]+\)\s*', '', 'g'), chr(1), '![')"
)
_COLLAPSE = r"regexp_replace({}, '\n{{4,}}', E'\n\n\n', 'g')"
_CLEAN = _strip(_COLLAPSE.format(_NO_EMPTY))

# --- metadata -------------------------------------------------------------------


def _first_meta(key: str) -> str:
    return (
        f"coalesce(nullif(arg_min(content, pos) FILTER (name = '{key}'), ''),"
        f" nullif(arg_min(content, pos) FILTER (property = '{key}'), ''))"
    )


_META_TAGS = rf"""met AS (
  SELECT page_id, pos, tag,
    regexp_extract(raw, '\sname="([^"]*)"', 1) AS name,
    regexp_extract(raw, '\sproperty="([^"]*)"', 1) AS property,
    {_decode(r"regexp_extract(raw, '\scontent=\"([^\"]*)\"', 1)").replace(chr(92) + '"', '"')} AS content,
    regexp_extract(raw, '\shref="([^"]*)"', 1) AS href,
    regexp_extract(raw, '\sdatetime="([^"]*)"', 1) AS datetime,
    raw LIKE '%rel="canonical"%' AS canonical, is_close
  FROM tok WHERE kind = 'tag'),
val AS (
  SELECT page_id, {", ".join(_first_meta(k) + ' AS ' + v for k, v in (
      ('author', 'author'), ('article:author', 'article_author'), ('og:title', 'og_title'),
      ('og:description', 'og_description'), ('description', 'description'),
      ('date', 'd_date'), ('article:published_time', 'd_published'),
      ('og:image', 'og_image'), ('og:type', 'og_type'), ('og:site_name', 'og_site_name')))},
    arg_min(href, pos) FILTER (tag = 'link' AND canonical) AS canonical_url,
    arg_min(datetime, pos) FILTER (tag = 'time' AND NOT is_close) AS time,
    count(*) FILTER (tag = 'img') AS images,
    count(*) FILTER (tag IN ('video', 'iframe') AND NOT is_close) AS videos
  FROM met GROUP BY page_id),
ttl AS (
  SELECT t.page_id, {_strip(_decode("string_agg(t.raw, '' ORDER BY t.pos)"))} AS title
  FROM tok t JOIN (
    SELECT page_id, min(pos) FILTER (tag = 'title' AND NOT is_close) AS o,
      min(pos) FILTER (tag = 'title' AND is_close) AS c FROM tok GROUP BY page_id) b
    ON b.page_id = t.page_id AND t.pos > b.o AND t.pos < b.c
  GROUP BY t.page_id)"""

_MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def _meta_date(v: str) -> str:
    return (
        f"CASE WHEN {v} LIKE '%T%' THEN CASE WHEN regexp_matches({v}, "
        r"'^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}')"
        f" THEN strftime(try_strptime(left({v}, 10), '%Y-%m-%d'), '%Y-%m-%d') END "
        rf"WHEN regexp_matches({v}, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN left({v}, 10) END"
    )


def _text_date(t: str) -> str:
    month_first = (
        rf"regexp_replace(replace(replace(regexp_extract({t}, "
        rf"'(?i)(?:{_MONTHS}|{_SHORT})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}}'), ',', ''), '.', ''), '\s+', ' ', 'g')"
    )
    day_first = rf"regexp_replace(regexp_extract({t}, '(?i)\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}'), '\s+', ' ', 'g')"
    tries = (
        (rf"regexp_extract({t}, '\d{{4}}-\d{{2}}-\d{{2}}')", "%Y-%m-%d"),
        (month_first, "%B %d %Y"),
        (month_first, "%b %d %Y"),
        (day_first, "%d %B %Y"),
    )
    return (
        "strftime(coalesce("
        + ", ".join(f"try_strptime({x}, '{f}')" for x, f in tries)
        + "), '%Y-%m-%d')"
    )


_DATES = f"""dts AS (
  SELECT p.page_id, p.url, coalesce({_meta_date('d_date')}, {_meta_date('d_published')},
    {_meta_date('time')}, {_text_date('left(text, 1000)')}) AS published_date
  FROM meta_pages p LEFT JOIN val USING (page_id) LEFT JOIN txt USING (page_id))"""


def _domains(source: str, k: int) -> str:
    return f"""dom AS (
  SELECT page_id, string_agg(netloc, ' ' ORDER BY c DESC, f) AS domains,
    list(netloc ORDER BY c DESC, f) AS listed FROM (
    SELECT page_id, netloc, count(*) AS c, min(pos) AS f,
      row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(pos)) AS r
    FROM (SELECT page_id, pos, {_netloc('href')} AS netloc, {_netloc('url')} AS own FROM a
      WHERE {_OK_HREF})
    WHERE netloc <> '' AND netloc <> own GROUP BY page_id, netloc)
  WHERE r <= {k} GROUP BY page_id),
cnt AS (
  SELECT page_id, count(*) FILTER (ext) AS external, count(*) FILTER (NOT ext) AS internal FROM (
    SELECT page_id, {_netloc('href')} <> '' AND {_netloc('href')} <> {_netloc('url')} AS ext
    FROM a WHERE {_OK_HREF})
  GROUP BY page_id)"""


_RECORD = f"""rec AS (
  SELECT p.page_id, p.url, coalesce(og_title, title, '') AS title,
    coalesce(og_description, description, '') AS description,
    coalesce(author, article_author, '') AS author, published_date,
    ({_WORDS})::BIGINT AS word_count,
    greatest(1, round_even(({_WORDS}) / 238.0, 0))::BIGINT AS reading_time_minutes,
    coalesce(internal, 0)::BIGINT AS internal_link_count,
    coalesce(external, 0)::BIGINT AS external_link_count,
    listed AS domains, coalesce(images, 0)::BIGINT AS image_count,
    coalesce(videos, 0)::BIGINT AS video_count, coalesce(canonical_url, '') AS canonical_url,
    coalesce(og_image, '') AS og_image, coalesce(og_type, '') AS og_type,
    coalesce(og_site_name, '') AS og_site_name
  FROM meta_pages p LEFT JOIN val USING (page_id) LEFT JOIN ttl USING (page_id)
    LEFT JOIN txt USING (page_id) LEFT JOIN dom USING (page_id) LEFT JOIN cnt USING (page_id)
    LEFT JOIN dts USING (page_id))"""

_META = (META_PAGES, _tokens("meta_pages"), _TEXT, _META_TAGS)
_META_RECORD = (*_META, _DATES, _anchors("meta_pages"), _domains("meta_pages", 10), _RECORD)


def _json_text(v: str) -> str:
    return f"to_json({v})::VARCHAR"


_JSON_FIELDS = (
    "url", "title", "description", "author", "published_date", "word_count",
    "reading_time_minutes", "internal_link_count", "external_link_count", "domains",
    "image_count", "video_count", "canonical_url", "og_image", "og_type", "og_site_name",
)


def _json() -> str:
    lines = []
    for f in _JSON_FIELDS:
        if f == "domains":
            value = (
                "CASE WHEN domains IS NULL THEN '[]' ELSE E'[\\n    ' || array_to_string("
                "[to_json(x)::VARCHAR for x in domains], E',\\n    ') || E'\\n  ]' END"
            )
            lines.append(f"'  \"top_external_domains\": ' || {value}")
        else:
            lines.append(f"'  \"{f}\": ' || coalesce({_json_text(f)}, 'null')")
    return "E'{\\n' || " + " || E',\\n' || ".join(lines) + " || E'\\n}'"


# --- conversion -------------------------------------------------------------------


# Text of a block: blanks and line breaks collapsed, emphasis marks escaped.
_FLOW = (
    r"regexp_replace(regexp_replace(regexp_replace({}, '[\t ]+', ' ', 'g'), ' ?\n[ \n]*', E'\n', 'g'),"
    r" '([*_])', '\\\1', 'g')"
)


def _markdown(source: str) -> str:
    """Blocks of the given pages: paragraphs, headings, divisions and articles.

    Lists and links occur only in navigation, which is dropped; a bold element is never
    closed and so runs to the end of its block.
    """
    flow = _FLOW.format(_decode("raw"))
    return rf"""{_tokens(source)},
{_DEPTH},
blk AS (
  SELECT *, kind = 'tag' AND tag IN ('html', 'head', 'body', 'div', 'article', 'nav', 'footer', 'p', 'h1',
      'ul', 'li', 'title') AS is_block
  FROM dep),
nst AS (
  SELECT *, count(*) FILTER (is_block) OVER w AS bid,
    sum(CASE WHEN is_block AND tag IN ('div', 'article', 'nav', 'footer', 'ul')
      THEN CASE WHEN is_close THEN -1 ELSE 1 END ELSE 0 END) OVER w AS inside,
    count(*) FILTER (is_block AND tag IN ('div', 'article')) OVER w AS container
  FROM blk WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
parts AS (
  SELECT page_id, bid, any_value(inside) AS inside, any_value(container) AS container,
    max(CASE WHEN is_block AND NOT is_close THEN tag END) AS tag, max(depth) AS depth,
    bool_or(is_block AND tag = 'title') AS title, bool_or(tag = 'b') AS bold,
    string_agg(CASE WHEN kind = 'text' THEN {flow} WHEN tag = 'br' THEN E'\n' ELSE '' END, '' ORDER BY pos) AS t
  FROM nst GROUP BY page_id, bid),
shown AS (
  SELECT page_id, bid, container, inside, tag, length({_strip('t')}) + CASE WHEN bold THEN 4 ELSE 0 END AS seen,
    length(t) - length(replace(t, ',', '')) AS commas,
    CASE WHEN tag = 'h1' THEN '# ' || replace({_strip('t')}, E'\n', ' ')
      WHEN bold THEN '**' || {_strip('t')} || '**' ELSE {_strip('t')} END AS t
  FROM parts WHERE depth = 0 AND NOT title AND {_strip('t')} <> '')"""


_RAW_MD = (
    "SELECT p.page_id, {cols}coalesce(m.markdown, '') AS markdown FROM {source} p LEFT JOIN ("
    "SELECT page_id, regexp_replace(string_agg(t, E'\\n\\n' ORDER BY bid), '[ \\t]+(\\n|$)', '\\1', 'g') AS markdown "
    "FROM shown {where} GROUP BY page_id) m USING (page_id)"
)


def _page_markdown(source: str, cols: str = "") -> str:
    return _RAW_MD.format(source=source, cols=cols, where="")


# Scores of the containers, which are all outermost here: the advert and the article.
_MAIN = """sco AS (
  SELECT page_id, bid, container, inside,
    CASE WHEN seen >= 25 AND coalesce(tag, '') <> 'h1' THEN 2 + commas + least(seen / 100.0, 3.0)
      ELSE 0 END AS score FROM shown),
own AS (
  SELECT s.page_id, s.container, sum(score) +
    CASE WHEN any_value(c.tag) = 'div' THEN 5 ELSE 10 END AS score
  FROM sco s JOIN (SELECT page_id, container, tag FROM nst
    WHERE is_block AND tag IN ('div', 'article') AND NOT is_close) c USING (page_id, container)
  WHERE inside = 1 GROUP BY s.page_id, s.container HAVING sum(score) > 0),
body AS (SELECT page_id, sum(score * pow(2, -inside)) AS score FROM sco GROUP BY page_id),
best AS (SELECT page_id, max(score) AS score FROM own GROUP BY page_id),
main AS (
  SELECT s.* FROM shown s LEFT JOIN best b USING (page_id) LEFT JOIN body y USING (page_id)
    LEFT JOIN own o ON o.page_id = s.page_id AND o.container = s.container AND s.inside = 1
  WHERE coalesce(b.score <= y.score, TRUE) OR o.score >= least(b.score, greatest(10, 0.2 * b.score)))"""


def _rich_markdown(source: str, shown: str = "depth = 0") -> str:
    """Markdown of pages with lists, quotes, code, tables, links and images as ``rich``.

    Blocks are the runs of tokens from one block tag to the next. Lists, quotes and tables are
    counted open and closed; an item's number is its place among the items of the last list opened
    at its depth.
    """
    flow = _FLOW.format(_decode("raw"))
    return rf"""{_tokens(source)},
{_DEPTH},
rbl AS (
  SELECT *, kind = 'tag' AND tag IN ('html', 'head', 'body', 'div', 'article', 'nav', 'footer', 'header', 'p', 'h1', 'h2',
    'ul', 'ol', 'li', 'title', 'blockquote', 'pre', 'table', 'tr', 'th', 'td') AS is_block,
    CASE WHEN kind = 'tag' THEN CASE WHEN is_close THEN -1 ELSE 1 END ELSE 0 END AS step
  FROM dep),
rst AS (
  SELECT *, count(*) FILTER (is_block) OVER w AS bid,
    sum(CASE WHEN tag IN ('ul', 'ol') THEN step ELSE 0 END) OVER w AS lists,
    sum(CASE WHEN tag = 'blockquote' THEN step ELSE 0 END) OVER w AS quotes,
    sum(CASE WHEN tag = 'table' THEN step ELSE 0 END) OVER w AS tables,
    count(*) FILTER (tag = 'table' AND step = 1) OVER w AS table_no,
    count(*) FILTER (tag = 'tr' AND step = 1) OVER w AS row_no,
    last_value(CASE WHEN is_block THEN CASE WHEN is_close THEN '' ELSE tag END END IGNORE NULLS) OVER w AS holder,
    last_value(CASE WHEN tag = 'a' AND step = 1 THEN regexp_extract(raw, 'href="([^"]*)"', 1) END IGNORE NULLS) OVER w AS href
  FROM rbl WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
rpt AS (
  SELECT page_id, bid, any_value(lists) AS lists, any_value(quotes) AS quotes, any_value(tables) AS tables,
    any_value(table_no) AS table_no, any_value(row_no) AS row_no, max(depth) AS depth, any_value(holder) AS tag,
    bool_or(is_block AND tag = 'title') AS title, bool_or(tag = 'b') AS bold,
    max(CASE WHEN is_block AND tag = 'ol' AND NOT is_close THEN coalesce(nullif(regexp_extract(raw, 'start="(\d+)"', 1), ''), '1')::BIGINT END) AS start,
    string_agg(CASE WHEN kind = 'text' AND holder = 'pre' THEN {_decode('raw')} WHEN kind = 'text' THEN {flow}
      WHEN tag = 'br' THEN E'
' WHEN tag = 'a' AND step = 1 THEN '[' WHEN tag = 'a' AND step = -1 THEN '](' || href || ')'
      WHEN tag = 'img' THEN '![' || regexp_extract(raw, 'alt="([^"]*)"', 1) || '](' || regexp_extract(raw, 'src="([^"]*)"', 1) || ')'
      WHEN tag = 'em' THEN '*' WHEN tag = 'strong' THEN '**' ELSE '' END, '' ORDER BY pos) AS t
  FROM rst GROUP BY page_id, bid),
rls AS (
  SELECT *, max(CASE WHEN tag IN ('ul', 'ol') THEN bid END) OVER (PARTITION BY page_id, lists ORDER BY bid) AS list_id,
    max(CASE WHEN tag IN ('ul', 'ol') AND lists = 1 THEN bid END) OVER (PARTITION BY page_id ORDER BY bid) AS outer_list
  FROM rpt),
rnm AS (
  SELECT l.*, o.start AS first_no,
    count(*) FILTER (l.tag = 'li') OVER (PARTITION BY l.page_id, l.list_id, l.lists ORDER BY l.bid) AS item
  FROM rls l LEFT JOIN rls o ON o.page_id = l.page_id AND o.bid = l.list_id),
rtb AS (
  SELECT page_id, min(bid) AS bid, string_agg(line, E'
' ORDER BY row_no) AS t FROM (
    SELECT page_id, table_no, row_no, min(bid) AS bid, '| ' || string_agg({_strip('t')}, ' | ' ORDER BY bid) || ' |' ||
      CASE WHEN row_number() OVER (PARTITION BY page_id, table_no ORDER BY row_no) = 1
        THEN E'
|' || repeat(' --- |', count(*)) ELSE '' END AS line
    FROM rnm WHERE tables > 0 AND tag IN ('th', 'td') GROUP BY page_id, table_no, row_no)
  GROUP BY page_id, table_no),
rpc AS (
  SELECT page_id, bid, CASE WHEN lists > 0 THEN outer_list END AS list, CASE
      WHEN tag IN ('h1', 'h2') THEN repeat('#', right(tag, 1)::INT) || ' ' || replace({_strip('t')}, E'
', ' ')
      WHEN tag = 'li' AND lists > 0 THEN repeat('  ', lists::INT - 1) ||
        CASE WHEN first_no IS NULL THEN '- ' ELSE (first_no + item - 1) || '. ' END || {_strip('t')}
      WHEN tag = 'pre' THEN E'```
' || t || E'
```' WHEN quotes > 0 THEN '> ' || {_strip('t')}
      WHEN bold THEN '**' || {_strip('t')} || '**' ELSE {_strip('t')} END AS t
  FROM rnm WHERE {shown} AND tables = 0 AND NOT title AND {_strip('t')} <> ''
  UNION ALL SELECT page_id, bid, NULL, t FROM rtb),
rsp AS (
  SELECT *, CASE WHEN lag(bid) OVER w IS NULL THEN '' WHEN lag(list) OVER w = list THEN E'
' ELSE E'

' END AS gap
  FROM rpc WINDOW w AS (PARTITION BY page_id ORDER BY bid)),
rich AS (
  SELECT p.page_id, p.url, coalesce(regexp_replace(m.markdown, '[ 	]+(
|$)', '', 'g'), '') AS markdown
  FROM {source} p LEFT JOIN (
    SELECT page_id, string_agg(gap || t, '' ORDER BY bid) AS markdown FROM rsp GROUP BY page_id) m USING (page_id))"""


# FLT11's selector: child and sibling steps from the order of an article's children, links of the
# navigation from their tokens. Paragraphs end at the next block, so they are parts as they stand.
_SELECTED = rf"""kid AS (
  SELECT page_id, bid, tag, lag(tag) OVER w AS before, lag(tag, 2) OVER w AS further
  FROM nst WHERE is_block AND NOT is_close AND tag IN ('h1', 'p', 'div', 'ul')
    AND container = (SELECT max(n.container) FROM nst n WHERE n.page_id = nst.page_id AND n.tag = 'article' AND NOT n.is_close)
  WINDOW w AS (PARTITION BY page_id, container ORDER BY pos)),
bks AS (
  SELECT s.page_id, string_agg(t, E'\n\n' ORDER BY bid) AS blocks
  FROM shown s JOIN kid k USING (page_id, bid)
  WHERE k.tag = 'h1' OR (k.tag = 'p' AND (k.before = 'h1' OR (k.before = 'p' AND k.further = 'p')))
  GROUP BY s.page_id),
lnx AS (
  SELECT page_id, pos, depth, tag, is_close, raw, lead(CASE WHEN kind = 'text' THEN raw ELSE '' END) OVER w AS inner_text,
    lag(CASE WHEN kind = 'tag' AND NOT is_close THEN tag END) OVER w AS holder
  FROM dep WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
lks AS (
  SELECT page_id, string_agg('[' || {_strip(_FLOW.format(_decode('inner_text')))} || '](' ||
    regexp_extract(raw, 'href="([^"]*)"', 1) || ')', E'\n' ORDER BY pos) AS links
  FROM lnx WHERE tag = 'a' AND NOT is_close AND depth > 0 AND holder = 'li' AND raw LIKE '<a href="/t%'
  GROUP BY page_id)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # --- sources
    q["SRC1"] = (
        "SELECT page_id, url, length(html)::BIGINT AS html_chars, 200::BIGINT AS status,"
        " TRUE AS no_screenshot FROM pages"
    )
    q["SRC2"] = _with(_rich_markdown("pages", "TRUE"), select="SELECT page_id, markdown FROM rich")
    q["SRC3"] = f"""
SELECT page_id, source, CASE WHEN page_id % 8 = 0 OR page_id = 2 THEN 'file'
  WHEN regexp_matches(source, '^https?://') THEN 'url' ELSE 'error' END AS route
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'page-' || page_id || '.html'
    WHEN 1 THEN 'ftp://' || {_netloc('url')} ELSE url END AS source FROM pages)"""
    q["SRC4"] = """
SELECT page_id, CASE WHEN reason IS NULL THEN CASE page_id % 7
    WHEN 0 THEN html || chr(65533) WHEN 2 THEN html || '€“”'
    WHEN 4 THEN regexp_replace(html, '[^\x00-\x7F]', repeat(chr(65533), 2), 'g')
    ELSE html END END AS html, reason
FROM (SELECT *, CASE WHEN CASE page_id % 7 WHEN 0 THEN octet_length(encode(html)) + 1
      WHEN 1 THEN length(html) WHEN 2 THEN length(html) + 3 WHEN 3 THEN 2 * length(html) + 2
      WHEN 5 THEN 2 * length(html) + 1 ELSE octet_length(encode(html)) END > 30000 THEN 'size'
    WHEN page_id % 7 = 5 THEN 'bytes' WHEN page_id % 7 = 6 THEN 'charset' END AS reason
  FROM pages)"""
    # a lone half katakana in Shift_JIS, else a lead byte without its trail
    q["SRC4_double_byte"] = r"""
SELECT page_id, CASE WHEN reason IS NULL THEN
    regexp_replace(html, '[^\x00-\x7F]', '日', 'g') || CASE WHEN page_id % 20 = 4 THEN 'ｰ' ELSE '' END END AS html, reason
FROM (SELECT *, CASE WHEN page_id % 5 = 4 AND page_id % 4 <> 0 THEN 'bytes' END AS reason FROM pages)"""
    q["SRC5"] = _with(SITE_PAGES, select="""
SELECT page_id, url, (CASE WHEN url LIKE '%/p/0' THEN 500 ELSE status END)::BIGINT AS status
FROM site_pages WHERE status < 400 OR url LIKE '%/p/0'""")
    # --- sinks
    slugged = f"slugged AS (SELECT *, {_unique_slug('url')} AS slug FROM md_docs)"
    q["SNK1"] = _with(*_DOC_CITATIONS, slugged, select="""
SELECT slug || '.md' AS name, cited AS content FROM slugged JOIN cited USING (doc_id)""")
    q["SNK2"] = _with(*_DOC_CITATIONS, slugged, select="""
SELECT slug || '_refs.md' AS name, refs AS content FROM slugged JOIN refs USING (doc_id)
WHERE doc_id % 2 = 0""")
    q["SNK3"] = _with(*_DOC_CITATIONS, select="""
SELECT doc_id, cited || CASE WHEN doc_id % 2 = 0 THEN E'\\n' || refs ELSE '' END AS output
FROM cited JOIN refs USING (doc_id)""")
    q["SNK4"] = _with(*_META_RECORD, select=f"""
SELECT {_unique_slug('url')} || '_meta.json' AS name, {_json()} AS content FROM rec""")
    artefacts = (
        "art AS (SELECT slug, a.* FROM slugged JOIN cited USING (doc_id) JOIN refs USING (doc_id),"
        " unnest([{'artifact': 'article.md', 'ord': 0, 'text': cited, 'payload': NULL},"
        " {'artifact': 'references.md', 'ord': 1, 'text': CASE WHEN doc_id % 2 = 0 THEN refs END, 'payload': NULL},"
        " {'artifact': 'screenshot.png', 'ord': 2, 'text': NULL, 'payload': CASE WHEN doc_id % 3 = 0 THEN 'png' || doc_id END},"
        " {'artifact': 'article.pdf', 'ord': 3, 'text': NULL, 'payload': CASE WHEN doc_id % 5 = 0 THEN 'pdf' || doc_id END},"
        " {'artifact': 'metadata.json', 'ord': 4, 'text': CASE WHEN doc_id % 7 = 0 THEN '{\"id\": ' || doc_id || '}' END, 'payload': NULL}"
        "]) AS u(a) WHERE a.text IS NOT NULL OR a.payload IS NOT NULL)"
    )
    q["SNK5"] = _with(*_DOC_CITATIONS, slugged, artefacts, select="""
SELECT slug, artifact, ord::BIGINT AS ord, text, hex(encode(payload)) AS bytes_hex FROM art""")
    q["SNK6"] = """
SELECT 'doc_' || doc_id || '.pdf' AS name, text AS content FROM documents
UNION ALL SELECT 'doc_' || doc_id || '.png', text FROM documents WHERE doc_id % 3 = 0"""
    plain_pages = "meta_pages AS (SELECT page_id, url, html FROM pages)"
    q["SNK7"] = _with(
        plain_pages, _markdown("meta_pages"), _TEXT, _META_TAGS, _DATES, _anchors("meta_pages"),
        _domains("meta_pages", 10), _RECORD, "doc AS (" + _page_markdown("meta_pages") + ")",
        f"named AS (SELECT page_id, url, {_unique_slug('url')} AS slug FROM pages)",
        f"clean AS (SELECT page_id, slug, {_CLEAN} AS text FROM doc JOIN named USING (page_id))",
        f"record AS (SELECT page_id, slug, {_json()} AS text FROM rec JOIN named USING (page_id, url))",
        "paper AS (SELECT page_id, slug, url AS text FROM named WHERE page_id % 2 = 0)",
        """made AS (
  SELECT 'markdown' AS mode, page_id, slug || '.md' AS name, text FROM clean
  UNION ALL SELECT 'metadata', page_id, slug || '_meta.json', text FROM record
  UNION ALL SELECT 'pdf', page_id, slug || '.pdf', text FROM paper
  UNION ALL SELECT 'archive', page_id, slug || '/article.md', text FROM clean
  UNION ALL SELECT 'archive', page_id, slug || '/article.pdf', text FROM paper
  UNION ALL SELECT 'archive', page_id, slug || '/metadata.json', text FROM record)""",
        select="SELECT mode, page_id, name, octet_length(encode(text))::BIGINT AS size, md5(text) AS md5 FROM made")
    # --- filters
    q["FLT1"] = """
SELECT page_id, page_id % 10 = 0 AS is_empty, page_id % 10 = 0 AS is_blank FROM pages"""
    site = (SITE_PAGES, _anchors("site_pages"), _ABS)
    q["FLT2"] = _with(*site, select=f"SELECT page_id, pos, href FROM a WHERE {_OK_HREF}")
    q["FLT3"] = _with(*site, select=f"""
SELECT page_id, pos, abs_url FROM abs WHERE {_netloc('abs_url')} = {_netloc('url')}""")
    q["FLT4"] = _with(*site, select=f"""
SELECT page_id, pos, abs_url FROM abs WHERE {_scheme('abs_url')} IN ('http', 'https')""")
    q["FLT5"] = _with(*site, select="""
SELECT page_id, pos, abs_url FROM abs
WHERE NOT regexp_matches(abs_url, '(?i)\\.(jpg|jpeg|png|gif|svg|pdf|zip|tar|gz|css|js|xml)$')""")
    q["FLT6"] = _with(*site, select="""
SELECT page_id, pos, abs_url FROM abs WHERE abs_url GLOB 'https://s[0-4].*/p/?[!0-3]*'""")
    found_images = r"""img AS (
  SELECT d.doc_id, u.n::BIGINT - 1 AS pos, u.url FROM md_docs d, unnest(
    [x for x in regexp_extract_all(d.markdown, '!\[[^\]]*\]\(([^)]+)\)', 1) if x LIKE 'http%'])
    WITH ORDINALITY AS u(url, n))"""
    q["FLT7"] = _with(MD_DOCS, found_images, select="SELECT doc_id, pos, url AS image_url FROM img")
    usable = """ok AS (SELECT * FROM image_assets WHERE content_type LIKE 'image/%'
  OR content_type LIKE 'application/octet-stream%')"""
    q["FLT8"] = _with(IMAGE_ASSETS, usable, select="""
SELECT url, content_type, octet_length(bytes)::BIGINT AS size FROM ok""")
    q["FLT9"] = _with(MD_DOCS, select=r"""
SELECT doc_id, regexp_replace(markdown, '!\[[^\]]*\]\([^)]+\)\s*', '', 'g') AS markdown FROM md_docs""")
    q["FLT10"] = _with(_tokens("pages"), _DEPTH, select="""
SELECT page_id, pos, kind, tag, raw FROM dep WHERE depth = 0 AND kind <> 'raw'
  AND NOT (is_close AND tag IN ('nav', 'footer', 'header', 'aside'))""")
    q["FLT11"] = _with(_markdown("pages"), _SELECTED, select="""
SELECT page_id, coalesce(CASE WHEN links IS NULL THEN blocks WHEN blocks IS NULL THEN links
  ELSE links || E'\\n\\n' || blocks END, whole, '') AS markdown
FROM (SELECT page_id FROM pages) LEFT JOIN lks USING (page_id) LEFT JOIN bks USING (page_id)
  LEFT JOIN (SELECT page_id, string_agg(t, E'\\n\\n' ORDER BY bid) AS whole FROM shown GROUP BY page_id) USING (page_id)""")
    q["FLT12"] = _with(
        "src AS (SELECT doc_id, text || E'\\n[top](#h) [x](https://x.example)' AS markdown FROM documents)",
        *_citations("src"), select="SELECT doc_id, cited AS markdown FROM cited")
    # --- joins
    q["JN1"] = _with(*_SITE_EDGES, select=f"""
SELECT e.page_id, e.pos, s.page_id AS target_id, s.url AS target_url
FROM edges e JOIN site_pages s ON {_norm('s.url')} = e.norm_url""")
    # At most five moves are followed; with eight the page goes in a circle.
    q["JN1_redirects"] = _with(*_SITE_EDGES, select=f"""
SELECT e.page_id, e.pos, e.abs_url, s.page_id AS target_id,
  CASE WHEN s.n BETWEEN 1 AND 7 THEN s.url || '/at/' || s.n ELSE s.url END AS final_url
FROM edges e LEFT JOIN (SELECT *, (page_id // 7) % 9 AS n FROM site_pages) s
  ON {_norm('s.url')} = e.norm_url AND s.n <= 5""")
    q["JN2"] = _with(*_SITE_EDGES, select=f"""
SELECT page_id, norm_url FROM edges
WHERE norm_url NOT IN (SELECT {_norm('url')} FROM site_pages)""")
    q["JN3"] = _with(MD_DOCS, IMAGE_ASSETS, usable, found_images, select="""
SELECT doc_id, pos, url, content_type FROM (
  SELECT doc_id, url, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS pos
  FROM img GROUP BY doc_id, url) JOIN ok USING (url)""")
    numbered = """num AS (
  SELECT l.doc_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.ord) - 1 AS pos, l.url, f.n
  FROM lnk l JOIN fst f ON f.doc_id = l.doc_id AND f.url = l.url)"""
    q["JN4"] = _with(*_DOC_CITATIONS, numbered, select="SELECT doc_id, pos, url, n FROM num")
    q["JN5"] = _with(_tokens("pages"), select="""
SELECT page_id, count(*) FILTER (tag = 'p' AND NOT is_close) AS paragraphs,
  count(*) FILTER (tag = 'p' AND NOT is_close AND boxes = 0) AS child_paragraphs
FROM (
  SELECT t.*, sum(CASE WHEN kind = 'tag' AND tag IN ('div', 'ul', 'li', 'nav', 'footer')
      THEN CASE WHEN is_close THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS boxes
  FROM tok t JOIN (
    SELECT page_id, min(pos) FILTER (tag = 'article' AND NOT is_close) AS o,
      coalesce(min(pos) FILTER (tag = 'article' AND is_close), max(pos) + 1) AS c
    FROM tok GROUP BY page_id) b USING (page_id) WHERE t.pos >= b.o AND t.pos < b.c)
GROUP BY page_id""")
    # --- aggregations
    q["AGG1"] = _with(_tokens("pages"), _TEXT, select=f"""
SELECT page_id, ({_WORDS})::BIGINT AS word_count FROM pages LEFT JOIN txt USING (page_id)""")
    q["AGG2"] = rf"""
SELECT doc_id, greatest(1, round_even(({_WORDS.replace("'') = ''", "'') = ''")}) / 238.0, 0))::BIGINT AS minutes
FROM (SELECT doc_id, {_strip('text')} AS text FROM documents)"""
    q["AGG3"] = _with(SITE_PAGES, _anchors("site_pages"), _domains("site_pages", 10), select="""
SELECT page_id, coalesce(internal, 0) AS internal_links, coalesce(external, 0) AS external_links
FROM site_pages LEFT JOIN cnt USING (page_id)""")
    for name, k in (("AGG4", 10), ("SRT4", 2)):
        q[name] = _with(SITE_PAGES, _anchors("site_pages"), _domains("site_pages", k), select="""
SELECT page_id, coalesce(domains, '') AS domains FROM site_pages LEFT JOIN dom USING (page_id)""")
    q["AGG5"] = _with(*_META, select="SELECT page_id, images, videos FROM val")
    q["AGG6"] = _with(*_META, select="SELECT page_id, author, og_title, d_date AS date FROM val")
    q["AGG7"] = _with(*_META, select="""
SELECT page_id, coalesce(title, '') AS title, coalesce(canonical_url, '') AS canonical_url, time
FROM val LEFT JOIN ttl USING (page_id)""")
    q["AGG8"] = _with(*_META_RECORD, select="""
SELECT page_id, title, description, author, og_image, og_type, og_site_name FROM rec""")
    q["AGG9"] = _with(*_SITE_EDGES, select="SELECT page_id, pos, abs_url, norm_url FROM edges")
    q["AGG10"] = "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"
    q["AGG11"] = "SELECT page_id, html FROM pages"
    manifest = """man AS (
  SELECT url, left(md5(url), 12) || '.jpg' AS file_key, octet_length(bytes)::BIGINT AS size
  FROM ok WHERE url IN (SELECT url FROM img))"""
    q["AGG12"] = _with(MD_DOCS, IMAGE_ASSETS, usable, found_images, manifest, select="""
SELECT (SELECT count(*) FROM md_docs) AS pages,
  (SELECT sum(length(markdown))::BIGINT FROM md_docs) AS characters,
  (SELECT count(*) FROM man) AS images, (SELECT sum(size)::BIGINT FROM man) AS bytes""")
    q["AGG13"] = _with(*_DOC_CITATIONS, slugged, artefacts, select="""
SELECT slug, string_agg(artifact, ' ' ORDER BY ord) AS files FROM art GROUP BY slug""")
    # --- windows
    q["WIN1"] = _with(_tokens("pages"), _DEPTH, select="SELECT page_id, pos, tag, depth FROM dep")
    q["WIN2"] = _with(MD_DOCS, _HEADINGS, select="SELECT doc_id, markdown FROM headed")
    q["WIN3"] = q["JN4"]
    q["WIN4"] = _with(*site, select=f"""
SELECT norm_url, page_id, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY page_id, pos) AS k
  FROM (SELECT *, {_norm('abs_url')} AS norm_url FROM abs)) WHERE k = 1""")
    q["WIN5"] = _with(*_SITE_EDGES, _walk(10), select="""
SELECT seed_id, crawl_rank, level::BIGINT AS level, url FROM crawl""")
    # --- sorts and limits
    dated = (*_META, _DATES)
    q["SRT1"] = _with(*dated, select="""
SELECT page_id, published_date, row_number() OVER
  (ORDER BY published_date DESC NULLS LAST, url DESC) AS position FROM dts""")
    q["SRT2"] = _with(*dated, select="""
(SELECT 'newest' AS kind, page_id, published_date FROM dts
  ORDER BY published_date DESC NULLS LAST, url DESC LIMIT 25)
UNION ALL
(SELECT 'oldest', page_id, published_date FROM dts ORDER BY published_date NULLS FIRST, url LIMIT 25)""")
    q["SRT3"] = _with(*_SITE_EDGES, _walk(10), select="""
SELECT seed_id, crawl_rank, url FROM crawl WHERE crawl_rank <= 12""")
    q["SRT5"] = _with(*_DOC_CITATIONS, select="SELECT doc_id, refs AS references FROM refs").replace(
        "AS references", 'AS "references"'
    )
    q["SRT6"] = rf"""
SELECT doc_id, {_slug('long_url')} AS slug, least(length(text), 1000)::BIGINT AS searched_chars
FROM (SELECT *, 'https://d.example/' || regexp_replace(text, '[ \n#?]', '/', 'g') AS long_url FROM documents)"""
    # --- sets
    q["SET1"] = _with(*_SITE_EDGES, _walk(3), select="""
SELECT seed_id, level::BIGINT AS level, count(*) AS pages FROM crawl GROUP BY ALL""")
    q["SET2"] = _with(*_SITE_EDGES, _walk(1), select="""
SELECT DISTINCT norm_url FROM edges WHERE norm_url NOT IN (SELECT norm_url FROM crawl)""")
    q["SET3"] = _with(*_SITE_EDGES, select="""
SELECT norm_url, min(page_id) AS first_page_id FROM edges GROUP BY norm_url""")
    # --- scalar functions
    q["SC1"] = f"""
SELECT page_id, {_scheme('url')} AS scheme, {_netloc('url')} AS netloc, {_part('url', 3)} AS path,
  {_part('url', 4)} AS query, {_part('url', 5)} AS fragment FROM pages"""
    q["SC2"] = f"SELECT page_id, {_norm('url')} AS norm_url FROM pages"
    q["SC3"] = rf"""
SELECT page_id, href, CASE i WHEN 0 THEN root || '/x' WHEN 1 THEN root || dir || 'y?z=1'
  WHEN 2 THEN root || up || 'q' WHEN 3 THEN root || regexp_replace(regexp_replace(up, '[^/]+/$', ''), '[^/]+/$', '') || 'q'
  WHEN 4 THEN regexp_replace(url, '#.*$', '') || '#f' WHEN 5 THEN root || path || '?k=2'
  WHEN 6 THEN url WHEN 7 THEN scheme || '://o.example/p' WHEN 8 THEN root || dir
  ELSE root || dir || 'a/c' END AS abs_url
FROM (SELECT *, regexp_replace(dir, '[^/]+/$', '') AS up FROM (
  SELECT *, scheme || '://' || {_netloc('url')} AS root, regexp_replace(path, '[^/]*$', '') AS dir FROM (
    SELECT page_id, url, page_id % 10 AS i, {_scheme('url')} AS scheme, {_part('url', 3)} AS path,
      ['/x', 'y?z=1', '../q', '../../../q', '#f', '?k=2', '', '//o.example/p', './', 'a/./b/../c'][page_id % 10 + 1] AS href
    FROM pages)))"""
    q["SC4"] = f"SELECT page_id, {_unique_slug('url')} AS slug, {_slug('url')} AS plain FROM pages"

    def md(expr: str, name: str = "markdown") -> str:
        return _with(MD_DOCS, select=f'SELECT doc_id, {expr} AS "{name}" FROM md_docs')

    rstrip = r"regexp_replace({}, '[^\S\n]+(\n|$)', '\1', 'g')"
    q["SC5"] = md(_strip(rstrip.format(_COLLAPSE.format("markdown"))))
    q["SC6"] = "SELECT doc_id, text || ' Note[' || doc_id || ']' AS markdown FROM documents"
    q["SC7"] = md(_NO_EMPTY)
    q["SC8"] = md(_COLLAPSE.format("markdown"))
    q["SC9"] = _with(MD_DOCS, _HEADINGS, select=f"SELECT doc_id, {_CLEAN} AS markdown FROM headed")
    q["SC10"] = _with(*_DOC_CITATIONS, select="SELECT doc_id, cited AS markdown FROM cited")
    q["SC11"] = q["SRT5"]
    q["SC12"] = md(
        r"array_to_string([x for x in regexp_extract_all(markdown, '!\[[^\]]*\]\(([^)]+)\)', 1)"
        r" if x LIKE 'http%'], ' ')",
        "image_urls",
    )
    q["SC13"] = _with(IMAGE_ASSETS, select="""
SELECT url, left(md5(url), 12) || '.jpg' AS file_key FROM image_assets""")
    q["SC14"] = _with(IMAGE_ASSETS, select="""
SELECT url, 'data:' || content_type || ';base64,' || base64(bytes) AS data_uri FROM image_assets""")
    q["SC15"] = md("replace(replace(markdown, 'https://x.example', 'data:x'), 'data:x/1', 'one')")
    q["SC16"] = f"""
SELECT page_id, value, {_meta_date('value')} AS published_date FROM (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2024-02-' || day || 'T23:30:00-08:00'
    WHEN 1 THEN '2024-02-' || day || ' 10:00' WHEN 2 THEN 'Tue, ' || day || ' 2024'
    WHEN 3 THEN '2023-12-' || day || 'T05:00Z' ELSE 'on 2024-01-' || day END AS value
  FROM (SELECT page_id, lpad((page_id % 33)::VARCHAR, 2, '0') AS day FROM pages))"""
    q["SC17"] = f"""
SELECT doc_id, {_text_date('value')} AS published_date FROM (
  SELECT doc_id, CASE doc_id % 5
    WHEN 0 THEN '2024-02-' || lpad((doc_id % 33)::VARCHAR, 2, '0') || ' or 3 May 2021'
    WHEN 1 THEN 'MARCH ' || (doc_id % 33) || ', 2024'
    WHEN 2 THEN (doc_id % 33) || ' december 2022' WHEN 3 THEN 'Sep. ' || (doc_id % 33) || ' 2020'
    ELSE 'Sept ' || (doc_id % 33) || ' 2020' END || ' ' || text AS value
  FROM documents)"""
    q["SC18"] = _with(*dated, select="SELECT page_id, published_date FROM dts")
    q["SC19"] = md(_text_date("left(markdown, 1000)"), "published_date")
    q["SC20"] = _with(_tokens("pages"), _TEXT, select="""
SELECT page_id, coalesce(text, '') AS text FROM pages LEFT JOIN txt USING (page_id)""")
    q["SC21"] = _with(*_META_RECORD, select=f"SELECT page_id, {_json()} AS json FROM rec")
    # --- jobs
    q["JOB0"] = _with(_tokens("pages"), select="""
SELECT page_id, pos, kind, tag, is_close, raw FROM tok""")
    q["JOB1"] = _with(RICH_PAGES, _rich_markdown("rich_pages"), select="SELECT page_id, url, markdown FROM rich")
    main = _RAW_MD.replace("FROM shown", "FROM main")
    q["JOB2"] = _with(_markdown("pages"), _MAIN, select=main.format(
        source="pages", cols="p.url, ", where=""))
    q["JOB3"] = _with(MD_DOCS, _HEADINGS, select=f"""
SELECT doc_id, d.url, {_CLEAN.replace('(markdown', '(h.markdown')} AS markdown
FROM headed h JOIN md_docs d USING (doc_id)""")
    cleaned = f"cleaned AS (SELECT doc_id, {_CLEAN} AS markdown FROM headed)"
    q["JOB4"] = _with(MD_DOCS, _HEADINGS, cleaned, *_citations("cleaned"), select="""
SELECT doc_id, cited AS markdown, refs AS "references" FROM cited JOIN refs USING (doc_id)""")
    q["JOB5"] = _with(*_META_RECORD, select="""
SELECT * EXCLUDE (domains), array_to_string(domains, ' ') AS top_external_domains FROM rec""")
    q["JOB6"] = _with(_anchors("pages"), _ABS, _EDGES, select="SELECT * FROM edges")
    q["JOB7"] = _with(*_SITE_EDGES, _walk(4), select="""
SELECT seed_id, crawl_rank, level::BIGINT AS level, parent_url, url, norm_url, page_id
FROM crawl WHERE crawl_rank <= 20""")
    job8 = (
        MIRRORED_SITE, _anchors("site_pages"), _ABS, _EDGES, _walk(10), _markdown("site_pages"),
        "doc AS (" + _page_markdown("site_pages") + ")",
        """dates AS (
  SELECT page_id, max(regexp_extract(raw, 'name="date" content="([^"]*)"', 1)) AS published_date
  FROM tok WHERE raw LIKE '<meta name="date"%' GROUP BY page_id)""", """fresh AS (
  SELECT c.seed_id, c.crawl_rank, c.level, c.page_id, c.url, d.published_date, m.markdown,
    row_number() OVER (PARTITION BY c.seed_id, m.markdown ORDER BY c.crawl_rank) AS copy
  FROM crawl c JOIN doc m USING (page_id) LEFT JOIN dates d USING (page_id))""", """kept AS (
  SELECT *, row_number() OVER (PARTITION BY seed_id
    ORDER BY published_date DESC NULLS LAST, url DESC) AS r FROM fresh WHERE copy = 1)""",
        "kept_pages AS (SELECT DISTINCT page_id, url FROM kept WHERE r <= 25)",
        f"named AS (SELECT page_id, {_unique_slug('url')} AS slug FROM kept_pages)",
    )
    q["JOB8"] = _with(
        *job8,
        select=f"""
SELECT seed_id, crawl_rank, level::BIGINT AS level, page_id, url, published_date, slug, {_CLEAN} AS output
FROM kept JOIN named USING (page_id) WHERE r <= 25""")
    q["AGG12_run"] = _with(*job8, select="""
SELECT (SELECT count(*) FROM crawl) AS crawled, count(*) AS "unique", count(*) FILTER (r <= 25) AS processed
FROM kept""")
    bare = r"regexp_replace(markdown, '!\[[^\]]*\]\([^)]+\)\s*', '', 'g')"
    q["JOB9"] = _with(
        RICH_PAGES, _rich_markdown("rich_pages"),
        f"clean AS (SELECT page_id AS doc_id, {_CLEAN} AS markdown FROM rich)",
        f"cleaned AS (SELECT doc_id, {bare} AS markdown FROM clean)", *_citations("cleaned"),
        select="""
SELECT doc_id AS page_id, cited AS markdown, coalesce(refs, '') AS "references",
  cited || CASE WHEN refs IS NULL THEN '' ELSE chr(10) || refs END AS output
FROM cited LEFT JOIN refs USING (doc_id)""")
    q["JOB10"] = _with(MD_DOCS, IMAGE_ASSETS, usable, select=r"""
SELECT doc_id, replace(replace(markdown,
    coalesce(x.url, chr(1)), coalesce('data:' || x.content_type || ';base64,' || base64(x.bytes), '')),
    coalesce(y.url, chr(1)), coalesce('data:' || y.content_type || ';base64,' || base64(y.bytes), '')) AS markdown
FROM md_docs d
LEFT JOIN ok x ON x.url = 'https://img.example/' || (doc_id // 4) || '.jpg'
LEFT JOIN ok y ON y.url = 'https://img.example/' || (doc_id // 4 + 1) || '.jpg'""")
    q["JOB11"] = _with(MD_DOCS, IMAGE_ASSETS, usable, found_images, manifest, select=r"""
SELECT url, file_key, size, TRUE AS is_new FROM man
WHERE regexp_extract(url, '/(\d+)\.jpg$', 1)::BIGINT % 2 <> 0
UNION ALL
SELECT url, left(md5(url), 12) || '.jpg', 7, FALSE FROM image_assets
WHERE regexp_extract(url, '/(\d+)\.jpg$', 1)::BIGINT % 2 = 0 AND url IN (SELECT url FROM img)""")
    q["JOB12"] = _with(
        RICH_PAGES, "meta_pages AS (SELECT * FROM rich_pages)", _rich_markdown("meta_pages"), _TEXT,
        _META_TAGS, _DATES, _anchors("meta_pages"), _domains("meta_pages", 10), _RECORD,
        f"cleaned AS (SELECT page_id AS doc_id, {_CLEAN} AS markdown FROM rich)", *_citations("cleaned"),
        f"named AS (SELECT page_id, page_id AS doc_id, url, {_unique_slug('url')} AS slug FROM pages)",
        select=f"""
SELECT slug, 'article.md' AS artifact, cited AS text, NULL AS bytes_hex FROM cited JOIN named USING (doc_id)
UNION ALL SELECT slug, 'references.md', refs, NULL FROM refs JOIN named USING (doc_id)
UNION ALL SELECT slug, 'metadata.json', json, NULL
FROM (SELECT page_id, {_json()} AS json FROM rec) JOIN named USING (page_id)
UNION ALL SELECT slug, 'screenshot.png', NULL, hex(encode(url)) FROM named WHERE page_id % 2 = 0""",
    )
    return q

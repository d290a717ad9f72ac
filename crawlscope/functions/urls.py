"""URL column expressions: split, resolve, normalise, compare, slug, content path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions.arrays import bind

# scheme, authority, path, query, fragment of RFC 3986 appendix B.
_PARTS = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
_MARK = "\u0001"
_ODD_CHARS = r"[^\x21-\x7E]|[\"<>`{}]"


def tidy(url: Column) -> Column:
    """Drop what URL parsers drop: tabs and line breaks, and blanks and control characters in front. Those at the
    end stay, as the form of an address must not depend on what stands behind it."""
    return F.regexp_replace(F.translate(url, "\t\r\n" + _MARK, ""), r"^[\x00-\x20]+", "")


def split_url(url: Column) -> Column:
    """ARRAY of scheme, authority, path, query, fragment: one match for all five."""
    marked = F.regexp_replace(tidy(url), _PARTS, _MARK.join(f"${i}" for i in range(1, 6)))
    return F.split(marked, _MARK, -1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    """Host with port and user info, case kept."""
    return F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    full = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return _drop_params(full)


def _drop_params(full_path: Column) -> Column:
    return F.regexp_replace(full_path, r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def same_origin(left: Column, right: Column) -> Column:
    """Same host and port; the scheme does not count."""
    return netloc(left) == netloc(right)


def remove_dots(segments: Column) -> Column:
    """Fold ``.`` and ``..`` out of a list of path segments."""

    def fold(segs: Column) -> Column:
        kept = F.aggregate(
            segs,
            F.array().cast("array<string>"),
            lambda acc, seg: F.when(
                seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            )
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg))),
        )
        tail = F.when(F.element_at(segs, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        # Going up beyond the root eats the leading slash too.
        return F.regexp_replace(F.array_join(F.concat(kept, tail), "/"), r"^/?", "/")

    return bind(segments, fold)


def _merge_paths(base: Column, rel: Column) -> Column:
    folder = F.split(F.regexp_replace(base, r"/[^/]+$|^[^/]+$", "/"), "/", -1)
    folder = F.slice(folder, F.lit(1), F.size(folder) - 1)
    joined = F.concat(folder, F.split(rel, "/", -1))
    # Empty segments of a relative join vanish, except the leading and the trailing one.
    relative = bind(
        joined, lambda segs: F.filter(segs, lambda s, i: (s != "") | (i == 0) | (i == F.size(segs) - 1))
    )
    return remove_dots(F.when(rel.startswith("/"), F.split(rel, "/", -1)).otherwise(relative))


def _prefixed(mark: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(mark), text)).otherwise(F.lit(""))


def _assemble(scheme_: Column, netloc_: Column, path_: Column, query_: Column, fragment: Column) -> Column:
    return F.concat(scheme_, F.lit("://"), netloc_, path_, _prefixed("?", query_), _prefixed("#", fragment))


def resolve(href: Column, base: Column) -> Column:
    """RFC 3986 join of ``href`` against ``base`` (both raw strings)."""

    def join(raw: Column, h: Column, b: Column) -> Column:
        h_scheme, b_scheme = F.lower(h[0]), F.lower(b[0])
        return (
            F.when(raw == "", _assemble(b_scheme, b[1], b[2], b[3], b[4]))
            .when((h_scheme != "") & (h_scheme != b_scheme), raw)
            .when(h[1] != "", _assemble(b_scheme, h[1], h[2], h[3], h[4]))
            .when(
                h[2] == "",
                _assemble(b_scheme, b[1], b[2], F.when(h[3] != "", h[3]).otherwise(b[3]), h[4]),
            )
            # A plain absolute path is by far the most common case: skip the segment fold.
            .when(
                h[2].startswith("/") & ~h[2].contains("/."),
                _assemble(b_scheme, b[1], h[2], h[3], h[4]),
            )
            .otherwise(_assemble(b_scheme, b[1], _merge_paths(b[2], h[2]), h[3], h[4]))
        )

    return bind(
        tidy(href), lambda raw: bind(split_url(raw), lambda h: bind(split_url(base), lambda b: join(raw, h, b)))
    )


def _percent_encode(text: Column) -> Column:
    """Percent-encode blanks, quotes and non-ASCII characters, as an address bar does."""

    def encode(t: Column) -> Column:
        chars = F.transform(
            F.split(t, ""),
            lambda c: F.when(
                c.rlike(_ODD_CHARS), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
            ).otherwise(c),
        )
        return F.when(t.rlike(_ODD_CHARS), F.array_join(chars, "")).otherwise(t)

    return bind(text, encode)


def dom_href(href: Column, base: Column) -> Column:
    """The absolute address a browser reports for ``href`` on page ``base``.

    Scheme and host lower-cased, an empty path becomes ``/``, odd characters are encoded.
    """

    def as_browser(full: Column) -> Column:
        def web(p: Column) -> Column:
            path_ = F.coalesce(F.nullif(p[2], F.lit("")), F.lit("/"))
            return _percent_encode(_assemble(F.lower(p[0]), F.lower(p[1]), path_, p[3], p[4]))

        return F.when(full.rlike("(?i)^https?:"), bind(split_url(full), web)).otherwise(full)

    return bind(resolve(F.regexp_replace(href, r"[\x00-\x20]+$", ""), base), as_browser)


def _decode(text: Column) -> Column:
    # A stray % stays as it is, so protect it before decoding.
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    # url_encode keeps "*" and encodes "~"; form encoding of web crawlers does the reverse.
    return F.replace(
        F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def clean_query(raw: Column) -> Column:
    """Decode the pairs, drop tracking keys, sort by (key, value), encode again."""
    tracking = F.array(*[F.lit(k) for k in dims.TRACKING_KEYS])
    pairs = F.transform(
        F.filter(F.split(raw, "&", -1), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.regexp_replace(p, r"(?s)^[^=]*=?", "")).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda kv: ~F.array_contains(tracking, kv["k"])))
    return F.array_join(
        F.transform(kept, lambda kv: F.concat(_encode(kv["k"]), F.lit("="), _encode(kv["v"]))), "&"
    )


def normalize(url: Column, base: Column | None = None) -> Column:
    """Canonical form of a web URL; null when the scheme is not http or https."""

    def canonical(p: Column) -> Column:
        bare = F.rtrim(_drop_params(p[2]), F.lit("/"))
        rooted = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
        params = F.regexp_extract(p[2], r"(;[^/]+)$", 1)
        tail = F.when(p[3] == "", F.lit("")).otherwise(_prefixed_query(p[3]))
        return F.when(
            F.lower(p[0]).isin("http", "https"),
            F.concat(F.lower(p[0]), F.lit("://"), p[1], rooted, params, tail),
        )

    return bind(split_url(url if base is None else resolve(url, base)), canonical)


def _prefixed_query(raw: Column) -> Column:
    return bind(clean_query(raw), lambda q: _prefixed("?", q))


def is_web(url: Column) -> Column:
    """True where ``normalize`` gives a URL; a cheap test, so filters need not normalise."""
    return tidy(url).rlike(r"(?i)^https?:")


def site_path(url: Column) -> Column:
    """Path without trailing slashes, ``/`` for the root."""
    return F.coalesce(F.nullif(F.rtrim(path(url), F.lit("/")), F.lit("")), F.lit("/"))


def _dashes(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[^a-zA-Z0-9_-]+", "-"), F.lit("-"))


def slug(url: Column) -> Column:
    base = F.coalesce(F.nullif(_dashes(F.btrim(path(url), F.lit("/"))), F.lit("")), F.lit("home"))
    tail = bind(_dashes(query(url)), lambda q: _prefixed("-", q))
    return F.left(F.concat(base, tail), F.lit(80))


def inner_path(url: Column) -> Column:
    """Path without outer slashes."""
    return F.btrim(path(url), F.lit("/"))


def leaf_content_path(url: Column, root: str = dims.CONTENT_ROOT) -> Column:
    """Mirror file of a page that is no folder; a query adds a short hash to the name."""
    inner = F.regexp_replace(inner_path(url), r"/(?:\.?/)+", "/")
    inner = F.coalesce(F.nullif(inner, F.lit("")), F.lit("_index"))
    suffix = bind(
        query(url),
        lambda q: F.when(q == "", F.lit("")).otherwise(
            F.concat(F.lit("__q-"), F.left(F.sha1(q.cast("binary")), F.lit(10)))
        ),
    )
    return F.concat(F.lit(root + "/"), inner, suffix, F.lit(".md"))


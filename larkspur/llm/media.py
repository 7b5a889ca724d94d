"""Interleaved document sequences: pages parsed to ordered text and media references, with payloads joined by digest.

A page becomes one array of items in reading order. A media item carries its caption and alternative text in the same
struct, so nothing can come out of line. Inline payloads (data: addresses) are addressed by their SHA-256 and stored once;
payloads, inline or from a store, are joined by digest. Pages without any media tag never take part in that join.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import html
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import OWN, materialize

#: Elements whose content is dropped, up to their own end tag. Of noscript only the text is: see parse().
_SILENT = "script|style|template|title|textarea|svg"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # Closed in itself, by a slash that isn't the end of an unquoted value.
    rf"""|<(?:{_SILENT})(?=[\s/>])(?:[^>"'=/]++|/(?!>)|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)?+|"[^"]*+"|'[^']*+')*+/>"""
    rf"|<({_SILENT})(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"
    r"""|<(/?)([a-z][a-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-z][^>]*+>|<[!?/][^>]*+>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
#: Tags that neither begin nor end a block of text.
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_MEDIA = {"img": "image", "video": "video", "audio": "audio"}
#: Pages that share a payload and are joined with it in one place; a payload that more pages hold is sent to several.
HOT = 10_000
#: Such payloads' digests (some 60 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: No page without a match of this has a media item.
HINT = r"(?i)<(?:img|video|audio)"

ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("src", pa.string()), ("digest", pa.string()), ("mime", pa.string()), ("alt", pa.string()), ("caption", pa.string())])
PAYLOAD = pa.struct([("digest", pa.string()), ("content", pa.binary())])
_ITEM_DDL = "array<struct<position: int, kind: string, text: string, src: string, digest: string, mime: string, alt: string, caption: string>>"
_PAYLOAD_DDL = "array<struct<digest: string, content: binary>>"


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _inline_payload(src: str) -> tuple[str, bytes] | None:
    """(mime, bytes) of a data: address; None if it is broken."""
    head, comma, body = src[5:].partition(",")
    if not comma:
        return None
    mime, *flags = head.split(";")
    try:
        data = base64.b64decode(re.sub(r"\s", "", unquote_to_bytes(body).decode("ascii")), validate=True) if "base64" in [f.strip().lower() for f in flags] else unquote_to_bytes(body)
    except (binascii.Error, UnicodeDecodeError):
        return None
    return mime.strip().lower() or "text/plain", data


def _integrity(value: str) -> str | None:
    """The SHA-256 that an integrity attribute gives, in hex."""
    for word in value.split():
        if word.lower().startswith("sha256-"):
            try:
                raw = base64.b64decode(word[7:].split("?")[0], validate=True)
            except binascii.Error:
                continue
            if len(raw) == 32:
                return raw.hex()
    return None


def parse(page: str, url: str | None = None) -> tuple[list[dict], list[dict]]:
    """The items of a page in order, and its inline payloads. Broken markup never raises: what is no tag is text."""
    items: list[dict] = []
    payloads: list[dict] = []
    pieces: list[str] = []
    caption: list[str] | None = None
    figure, open_media, base = None, None, url or ""

    def flush() -> None:
        nonlocal pieces
        if pieces:
            if text := _SPACE.sub(" ", html.unescape("".join(pieces))).strip():
                items.append({"position": len(items), "kind": "text", "text": text})
            pieces = []

    def refer(item: dict, a: dict[str, str]) -> None:
        src = (a.get("src") or a.get("data-src") or a.get("srcset", "").strip().split(" ")[0]).strip()
        if src[:5].lower() == "data:":
            if got := _inline_payload(src):
                item["digest"] = hashlib.sha256(got[1]).hexdigest()
                item["src"] = "sha256:" + item["digest"]
                item["mime"] = got[0]
                payloads.append({"digest": item["digest"], "content": got[1]})
        elif src:
            item["digest"] = _integrity(a.get("integrity", ""))
            try:
                item["src"] = urljoin(base, src)
            except ValueError:
                item["src"] = src

    def close_figure() -> None:
        nonlocal figure, caption
        if figure is not None and caption:
            said = _SPACE.sub(" ", html.unescape("".join(caption))).strip() or None
            media = [i for i in items[figure:] if i["kind"] != "text"]
            for i in media:
                i["caption"] = said
            if not media and said:
                items.append({"position": len(items), "kind": "text", "text": said})
        figure = caption = None

    def text(piece: str) -> None:
        if not quiet:
            (pieces if not captioning else caption).append(piece)

    at, captioning, quiet = 0, False, False
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at, tag = m.end(), m[3]
        if tag is None:
            continue
        tag, ends = tag.lower(), bool(m[2])
        if tag == "noscript":  # its media count, its text doesn't
            quiet = not ends and not m[4].endswith("/")
        if tag in _INLINE or tag == "noscript" or quiet and tag not in _MEDIA and tag != "source":
            continue
        if captioning and tag not in ("figcaption", "figure"):
            if tag not in _MEDIA:
                caption.append(" ")
                continue
        if not captioning:
            flush()
        if tag in _MEDIA:
            if ends:
                open_media = None
                continue
            a = _attributes(m[4])
            item = {"position": len(items), "kind": _MEDIA[tag], "alt": a.get("alt") or a.get("title") or None}
            refer(item, a)
            items.append(item)
            open_media = item if tag != "img" else open_media
        elif tag == "source" and open_media is not None and not open_media.get("src"):
            refer(open_media, _attributes(m[4]))
        elif tag == "figure":
            captioning = False
            close_figure()
            if not ends:
                figure = len(items)
        elif tag == "figcaption" and figure is not None:
            captioning = not ends
            caption = caption if caption is not None else []
        elif tag == "base" and (href := _attributes(m[4]).get("href")):
            try:
                base = urljoin(url or "", href)
            except ValueError:
                pass
    if at < len(page):
        text(page[at:])
    flush()
    close_figure()
    return items, payloads


def parse_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, url, keep..., items (null for a null html), payloads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few pages at a time, so that long ones don't add up.
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = [(None, []) if h is None else parse(h, u) for h, u in zip(part.column("html").to_pylist(), part.column("url").to_pylist())]
                columns = [part.column(c) for c in ("page_id", "url", *keep)]
                columns += [pa.array([g[0] for g in got], pa.list_(ITEM)), pa.array([g[1] for g in got], pa.list_(PAYLOAD))]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", *keep, "items", "payloads"])

    kinds = "".join(f", {c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select("page_id", "url", *keep, "html").mapInArrow(read, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string{kinds}, items {_ITEM_DDL}, payloads {_PAYLOAD_DDL}")


def sequences(pages: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """(page_id, url, items): a row a page, items an array of (position, kind, text, src, digest, alt, caption, mime, payload).

    pages has page_id, url and html; other columns are not read. store: (digest, mime, content) of payloads that pages refer
    to by an integrity digest; of several rows for a digest the one of the least mime, then content, is taken. Inline payloads need no
    store, and each keeps the mime that its own address gives. kind is text, image, video or audio (object, embed and iframe are no
    media, nor are alternatives in srcset beyond the first); positions count from 0 without gaps. A reference that nothing
    resolves, and a broken inline one, keeps a null payload. A
    figure's caption goes to each of its media; without any it is text. A null html gives null items, an empty one no items.
    Repeated rows each give a row. Pages of any length are parsed whole. An empty table gives an empty one.
    """
    item = "struct(i.position, i.kind, i.text, i.src, i.digest, i.alt, i.caption, {} AS mime, {} AS payload)"
    media = F.col("html").isNotNull() & F.col("html").rlike(HINT)
    plain = parse_pages(pages.where(~media | F.col("html").isNull())).select(
        "page_id", "url", F.expr("transform(items, i -> " + item.format("cast(null as string)", "cast(null as binary)") + ")").alias("items")
    )
    # Parsed once; a number stands for the row, which may be repeated.
    parsed = parse_pages(pages.where(media).withColumn(OWN + "page", F.monotonically_increasing_id()), keep=(OWN + "page",))
    parsed = materialize(parsed, "parsed")
    payloads = parsed.select(F.explode("payloads").alias("p")).select("p.digest", F.lit(None).cast("string").alias("mime"), "p.content")
    if store is not None:
        payloads = payloads.unionByName(store.select("digest", "mime", "content"))
    payloads = payloads.groupBy("digest").agg(F.min(F.struct(F.col("mime").isNull(), "mime", "content")).alias("p")).select("digest", "p.mime", "p.content")
    wanted = parsed.select(OWN + "page", F.explode(F.array_distinct(F.expr("transform(filter(items, i -> i.digest is not null), i -> i.digest)"))).alias("digest"))
    found = _spread(wanted, payloads).groupBy(OWN + "page").agg(F.map_from_entries(F.collect_list(F.struct("digest", F.struct("mime", "content")))).alias(OWN + "found"))
    joined = parsed.join(found, OWN + "page", "left")
    got = f"try_element_at({OWN}found, i.digest)"
    resolved = joined.select("page_id", "url", F.expr("transform(items, i -> " + item.format(f"coalesce(i.mime, {got}.mime)", got + ".content") + ")").alias("items"))
    return plain.unionByName(resolved)


def _spread(wanted: DataFrame, payloads: DataFrame) -> DataFrame:
    """wanted (own page, digest) with payloads: those that very many pages hold (a logo, a pixel) are copied, a part of the pages each."""
    parts = wanted.groupBy("digest").agg(F.ceil(F.count(F.lit(1)) / HOT).alias(OWN + "parts")).where(F.col(OWN + "parts") > 1)
    parts = materialize(parts, "hot")
    count = parts.count()
    if not count:
        return wanted.join(payloads, "digest")
    parts = F.broadcast(parts) if count <= BROADCAST_ROWS else parts
    many = F.coalesce(F.col(OWN + "parts"), F.lit(1))
    pages = wanted.join(parts, "digest", "left").withColumn(OWN + "part", F.pmod(F.xxhash64(OWN + "page"), many)).drop(OWN + "parts")
    copies = payloads.join(parts, "digest", "left").withColumn(OWN + "part", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop(OWN + "parts")
    return pages.join(copies, ["digest", OWN + "part"]).drop(OWN + "part")

"""Scalar column functions of manifests, calendars and commit texts. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"
MIB = 1 << 20
#: Image extensions that can be previewed.
IMAGE_MIME = {
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "ico": "image/x-icon",
    "avif": "image/avif",
    "svg": "image/svg+xml",
}
#: Kinds by extension, for display; a documented choice of our own beyond images.
KINDS = {
    "image": "png jpg jpeg gif webp bmp ico avif svg",
    "text": "txt md rst log csv tsv json yaml yml toml ini xml html htm",
    "code": "py js ts rs go java c h cpp cs rb php sh sql css vue",
    "archive": "zip gz tar 7z rar xz bz2 zst",
    "media": "mp3 wav flac ogg mp4 mov mkv webm avi",
    "document": "pdf doc docx xls xlsx ppt pptx odt",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_digest(blocks: Column | str) -> Column:
    """SHA-256 of the block hashes, one a line; no blocks (or null) give ''."""
    b = _c(blocks)
    return F.when(F.coalesce(F.size(b), F.lit(0)) < 1, "").otherwise(F.sha2(F.array_join(b, "\n"), 256))


def chunk_view(cdh: Column | str, clens: Column | str) -> Column:
    """Whether the content-defined view is usable: both lists there, not empty, of one length."""
    h, n = F.coalesce(F.size(_c(cdh)), F.lit(0)), F.coalesce(F.size(_c(clens)), F.lit(0))
    return (h > 0) & (h == n)


def entry_fingerprint(size: Column | str, blocks: Column | str, cdh: Column | str, clens: Column | str) -> Column:
    """Identity of one content: size, blocks, and the chunk view if usable, NUL-separated."""
    usable = chunk_view(cdh, clens)
    parts = [_c(size).cast("string"), F.array_join(_c(blocks), ","), F.when(usable, F.array_join(_c(cdh), ",")).otherwise(""), F.when(usable, F.array_join(F.transform(_c(clens), lambda n: n.cast("string")), ",")).otherwise("")]
    return F.sha2(F.concat_ws(NUL, *parts), 256)


def version_key(deleted: Column | str, fingerprint: Column) -> Column:
    """Key of an offered content: its fingerprint, or one constant for every tombstone."""
    return F.when(_c(deleted), "tombstone").otherwise(fingerprint)


def pick_slot(key: Column | str, slots: Column | str) -> Column:
    """A slot below `slots`, from the first 32 bits of the key's SHA-256."""
    n = _c(slots)
    first = F.conv(F.substring(F.sha2(_c(key), 256), 1, 8), 16, 10).cast("bigint")
    return F.when(n <= 1, F.lit(0).cast("bigint")).otherwise(first % F.greatest(n, F.lit(1)))


def day_key(ts: Column | str) -> Column:
    """YYYY-MM-DD in the session's time zone."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def is_real_date(text: Column | str) -> Column:
    t = _c(text)
    shaped = F.coalesce(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    return shaped & F.when(shaped, F.try_to_date(t, "yyyy-MM-dd").isNotNull()).otherwise(False)


def within_window(start: Column, stop: Column, minute: Column) -> Column:
    """[start, stop) in minutes of a day; equal ends are the whole day, start > stop wraps midnight."""
    return F.when(start == stop, True).when(start < stop, (minute >= start) & (minute < stop)).otherwise((minute >= start) | (minute < stop))


def within_schedule(rules: Column | str, ts: Column | str, workday: Column) -> Column:
    """rules: array<struct<kind:string, days:array<int>, windows:array<struct<start:int,stop:int>>>>.

    kind is any, workday, offday or dow (days 0 = Sunday). No rule, or none with a window that
    binds, is always.
    """
    r, t = _c(rules), _c(ts)
    minute, dow = F.hour(t) * 60 + F.minute(t), F.dayofweek(t) - 1
    free = F.coalesce(F.forall(r, lambda x: (F.size(x["windows"]) < 1) | F.exists(x["windows"], lambda w: w["start"] == w["stop"])), F.lit(True))

    def day(x: Column) -> Column:
        return F.when(x["kind"] == "any", True).when(x["kind"] == "workday", workday).when(x["kind"] == "offday", ~workday).otherwise(F.coalesce(F.array_contains(x["days"], dow), F.lit(False)))

    return free | F.exists(r, lambda x: day(x) & F.exists(x["windows"], lambda w: within_window(w["start"], w["stop"], minute)))


def extension(path: Column | str) -> Column:
    """Lower-case extension of the last segment; dotfiles and names without a dot have none."""
    return F.lower(F.regexp_extract(_c(path), r"(?s)^(?:.*/)?[^/]+\.([^./]*)$", 1))


def mime_of(path: Column | str) -> Column:
    """MIME type of an image that can be previewed, else null."""
    table = F.create_map(*[F.lit(x) for pair in IMAGE_MIME.items() for x in pair])
    return F.try_element_at(table, extension(path))


def compare_limit(path: Column | str) -> Column:
    """Bytes up to which a file's content is compared: images 8 MiB, others 2 MiB."""
    return F.when(mime_of(path).isNotNull(), F.lit(8 * MIB)).otherwise(F.lit(2 * MIB)).cast("bigint")


def file_kind(path: Column | str) -> Column:
    """image, text, code, archive, media, document or other."""
    table = F.create_map(*[F.lit(x) for kind, names in KINDS.items() for e in names.split() for x in (e, kind)])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("other"))


def strip_trailer(message: Column | str) -> Column:
    """A commit message without co-author lines and the blank lines right after each; trailing
    blank lines go too, if anything went."""
    m = _c(message)
    trailer = r"(?i)[^\n]*co-?authored-by[^\n]*"
    cut = F.regexp_replace(m, rf"(?:(?<=\n)|^){trailer}(?:\n[ \t\r\f\x0B]*(?=\n|$))*(?:\n|$)", "")
    return F.when(m.rlike(r"(?i)co-?authored-by"), F.regexp_replace(cut, r"(?:(?:\n|^)[ \t\r\f\x0B]*)+$", "")).otherwise(m)

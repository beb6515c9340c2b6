"""Text helpers: versions, checksum lists, event streams, JSON answers, privacy checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plane import let

# words that must not leave the machine inside a shared context
FORBIDDEN = ("api_key", "authorization", "sk-")
# keys of a context that hold a file's place
PATH_KEYS = ("video_path", "path")
# fields of an answer's usage record
USAGE_FIELDS = ("prompt_tokens", "completion_tokens", "total_tokens")


def version(tag: Column) -> Column:
    """array(major, minor, patch) of ``v1.2.3`` (leading v optional); null when malformed."""
    text = F.regexp_replace(F.trim(tag), "^[vV]", "")
    parts = F.split(text, r"\.")
    good = text.rlike(r"^\s*\+?\d+\s*\.\s*\+?\d+\s*\.\s*\+?\d+\s*$")
    return F.when(good, F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"^\+", "").cast("decimal(38,0)")))


def is_newer(remote: Column, current: Column) -> Column:
    """False when either tag is malformed."""
    return F.coalesce(version(remote) > version(current), F.lit(False))


def should_check(last_s: Column, now_s: Column, interval_s: float = 86400.0) -> Column:
    return (last_s <= 0) | (now_s - last_s >= interval_s)


def release_status(tag: Column, current: Column, draft: Column, prerelease: Column, skipped: Column) -> Column:
    """no_release, invalid, latest, skipped or available."""
    skip = F.coalesce(version(skipped) == version(tag), F.lit(False))
    return (
        F.when(F.coalesce(draft, F.lit(False)) | F.coalesce(prerelease, F.lit(False)), "no_release")
        .when(version(tag).isNull(), "invalid")
        .when(~is_newer(tag, current), "latest")
        .when(skip, "skipped")
        .otherwise("available")
    )


def checksums(text: Column) -> Column:
    """map file name -> lower-case SHA-256; comment and malformed lines drop, a later name wins."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")))
    words = F.transform(F.filter(lines, lambda line: ~line.startswith("#")), lambda line: F.split(line, " "))
    usable = F.filter(words, lambda w: (F.size(w) >= 2) & F.get(w, F.lit(0)).rlike("^[0-9a-fA-F]{64}$"))
    named = F.transform(
        usable,
        lambda w: F.struct(
            F.regexp_replace(F.regexp_replace(F.element_at(w, -1), r"^\*", ""), r"^.*/", "").alias("name"),
            F.lower(F.get(w, F.lit(0))).alias("digest"),
        ),
    )
    placed = F.transform(named, lambda e, i: F.struct(e["name"].alias("name"), i.alias("i"), e["digest"].alias("digest")))

    def last_of_name(v: Column) -> Column:
        ends = F.filter(v["s"], lambda e, i: ~F.get(v["s"], i + 1)["name"].eqNullSafe(e["name"]))
        return F.map_from_entries(F.transform(ends, lambda e: F.struct(e["name"], e["digest"])))

    return let({"s": F.array_sort(placed)}, last_of_name)


def sse_data(text: Column) -> Column:
    """Payloads of ``data:`` lines of an event stream, up to the end marker."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda line: line.startswith("data:"))
    data = F.transform(lines, lambda line: F.trim(F.substr(line, F.lit(6))))
    end = F.array_position(data, "[DONE]").cast("int")
    return F.when(end > 0, F.slice(data, F.lit(1), end - 1)).otherwise(data)


def json_object(text: Column) -> Column:
    """The JSON object inside an answer, without code fences or surrounding prose."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def leaks_secret(text: Column) -> Column:
    """First forbidden token contained in the text, or null."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for token in reversed(FORBIDDEN):
        out = F.when(F.contains(low, F.lit(token)), token).otherwise(out)
    return out


def leaks_context(context: Column) -> Column:
    """First forbidden word of a JSON context, ``path`` where one of its own keys is a path, or null."""
    keys = F.json_object_keys(context)
    return F.coalesce(leaks_secret(context), F.when(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in PATH_KEYS])), "path"))


def usage(answer: Column) -> Column:
    """struct of the token counts of a JSON answer; what is missing, null or broken counts 0."""
    fields = F.from_json(F.get_json_object(answer, "$.usage"), ", ".join(f"{n} bigint" for n in USAGE_FIELDS))
    return F.struct(*[F.coalesce(fields[n], F.lit(0).cast("long")).alias(n) for n in USAGE_FIELDS])


def http_outcome(status: Column) -> Column:
    """Class of an HTTP answer: ok, auth, rate_limited, retry or failed."""
    return (
        F.when((status >= 200) & (status < 300), "ok")
        .when(status.isin(401, 403), "auth")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "retry")
        .otherwise("failed")
    )

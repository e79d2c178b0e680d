"""Media columns over file bytes and metadata: type, safety flags, provenance findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions.text import strip


def _bytes_at(content: Column, offset: int, size: int) -> Column:
    return F.hex(F.substring(content, offset + 1, size))


def detect_type(content: Column) -> Column:
    """MIME type from magic bytes; null for fewer than twelve bytes or nothing known."""
    out = F.lit(None).cast("string")
    for offset, signature, mime in reversed(V.SIGNATURES):
        hit = _bytes_at(content, offset, len(signature) // 2) == signature
        if mime == "image/webp":
            hit = hit & (_bytes_at(content, 8, 4) == "57454250")
        out = F.when(hit, mime).otherwise(out)
    return F.when(F.octet_length(content) >= 12, out)


def _as_latin(content: Column, size: int | None) -> Column:
    return F.lower(F.decode(content if size is None else F.substring(content, 1, size), "ISO-8859-1"))


def has_markup(content: Column, size: int | None = 2048) -> Column:
    """Markup in the first `size` bytes, anywhere with None: the file also reads as a page or a script."""
    head = _as_latin(content, size)
    test = F.lit(False)
    for marker in V.MARKUP_MARKERS:
        test = test | head.contains(marker)
    return test


def upload_verdict(content: Column, declared: Column, kind: Column, detected: Column) -> Column:
    """First reason to refuse an upload, else null.  kind is IMAGE, SCREENSHOT or VIDEO."""
    size = F.octet_length(content)
    video = kind == "VIDEO"
    images = ("image/jpeg", "image/png", "image/gif", "image/webp")
    videos = ("video/mp4", "video/quicktime", "video/webm", "video/x-matroska")
    said = F.lower(strip(F.substring_index(declared, ";", 1)))
    mismatch = ~video & (F.coalesce(declared, F.lit("")) != "") & (said != detected) & (
        said != "application/octet-stream"
    )
    return (
        F.when(size == 0, "empty")
        .when(size > F.when(video, V.MAX_VIDEO_BYTES).otherwise(V.MAX_IMAGE_BYTES), "too_large")
        .when(detected.isNull(), "unsupported_type")
        .when(~video & ~detected.isin(*images), "unsupported_type")
        .when(video & ~detected.isin(*videos), "unsupported_type")
        .when(mismatch, "type_mismatch")
        .when(has_markup(content), "polyglot")
    )


def storage_key(media_id: Column, day: Column, mime: Column, prefix: str = "media") -> Column:
    ext = F.lit("bin")
    for name, extension in V.MIME_EXTENSIONS.items():
        ext = F.when(mime == name, extension).otherwise(ext)
    return F.concat(
        F.lit(prefix + "/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/"), media_id, F.lit("."), ext
    )


def has_c2pa(content: Column, size: int | None = 200_000, box_size: int | None = 8000) -> Column:
    """A content-credentials manifest near the start of the file: its name in `size` bytes or its box in `box_size`;
    None looks at the whole file."""
    return _as_latin(content, size).contains("c2pa") | _as_latin(content, box_size).contains("jumb")


def generator(metadata: Column) -> Column:
    """The first known generator named in metadata text, in list order."""
    lowered = F.lower(metadata)
    out = F.lit(None).cast("string")
    for marker, label in reversed(V.GENERATORS):
        out = F.when(lowered.contains(marker), label).otherwise(out)
    return out


def is_editor(software: Column) -> Column:
    lowered = F.lower(software)
    test = F.lit(False)
    for name in V.EDITORS:
        test = test | lowered.contains(name)
    return test


def exif_time(raw: Column) -> Column:
    text = strip(raw)
    return F.when(
        text.rlike(r"^\d{4}:\d{1,2}:\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
        F.try_to_timestamp(text, F.lit("y:M:d H:m:s")),
    )


def assessment(generator_name: Column, c2pa: Column) -> Column:
    return (
        F.when(generator_name.isNotNull(), "declared_generator")
        .when(c2pa, "provenance_present")
        .otherwise("undetermined")
    )


# Findings, caveats and strengths, in report order.
def signals(
    generator_name: Column,
    c2pa: Column,
    make: Column,
    model: Column,
    has_exif: Column,
    software: Column,
    captured_at: Column,
) -> Column:
    """array<struct(key, finding, caveat, strength)> of everything observed."""

    def signal(when: Column, key: str, finding: Column, caveat: str, strength: str) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(key).alias("key"), finding.alias("finding"), F.lit(caveat).alias("caveat"),
                F.lit(strength).alias("strength"),
            ),
        )

    camera = make.isNotNull() | model.isNotNull()
    empty = F.lit("")
    device = strip(F.concat(strip(F.coalesce(make, empty)), F.lit(" "), strip(F.coalesce(model, empty))))
    device = F.when(device == "", "a camera").otherwise(device)
    found = [
        signal(
            generator_name.isNotNull(), "generator_metadata",
            F.concat(F.lit("The file's metadata names "), generator_name, F.lit(".")),
            "This is strong evidence the image was produced or processed by that tool. Metadata can be "
            "edited, so it is not proof.",
            "strong",
        ),
        signal(
            c2pa, "c2pa_present",
            F.lit("The file carries a Content Credentials (C2PA) provenance manifest."),
            "We detected the manifest but did not validate its signature. Both cameras and AI generators "
            "attach these.",
            "moderate",
        ),
        signal(
            camera, "camera_metadata",
            F.concat(F.lit("The file carries camera metadata ("), device, F.lit(").")),
            "Consistent with a photograph, but camera metadata can be copied onto any file, so it is "
            "suggestive rather than conclusive.",
            "moderate",
        ),
        signal(
            ~camera & ~has_exif, "no_metadata", F.lit("The file carries no EXIF metadata."),
            "This is normal and expected: Facebook, WhatsApp, X and most other platforms strip metadata "
            "from every upload, and screenshots never have it. It is NOT an indication that the image is "
            "AI-generated.",
            "weak",
        ),
        signal(
            is_editor(software), "editing_software",
            F.concat(F.lit("The file was saved by "), software, F.lit(".")),
            "Editing software was used at some point. Nearly every published photograph is processed, so "
            "this is not a sign of manipulation.",
            "weak",
        ),
        signal(
            captured_at.isNotNull(), "capture_date",
            F.concat(F.lit("Metadata records a capture date of "), F.date_format(captured_at, "dd MMM yyyy"), F.lit(".")),
            "Useful for checking whether the file predates the event it is said to show. Capture dates can "
            "be altered.",
            "moderate",
        ),
    ]
    return F.array_compact(F.array(*found))

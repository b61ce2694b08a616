"""Normalising fields of source records: labels, paths, secrets, names of formats."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Extensions by image format, what marks a field as secret or local, and what stands in its place.
EXTENSIONS = {"BMP": "bmp", "GIF": "gif", "JPEG": "jpg", "JPEG2000": "jp2", "PNG": "png", "TIFF": "tiff", "WEBP": "webp"}
SECRET_MARKERS = ("authorization", "credential", "password", "secret", "signature", "token", "x-amz-credential", "x-amz-signature")
LOCAL_PATH = r"^(~/|/|[A-Za-z]:[\\/])"
REDACTED_SECRET, REDACTED_PATH = "[redacted-secret]", "[redacted-local-path]"
LONGEST_TEXT, LONGEST_ID = 16_384, 1_024


def _folded(marker: str) -> str:
    """Pattern of the marker in any case, the letters that only case folding makes equal included."""
    alike = {"s": "[sS\u017f]", "k": "[kK\u212a]"}
    one = lambda c: alike.get(c) or (f"[{c}{c.upper()}]" if c.isalpha() else c)
    return "".join("(?:[sS\u017f]{2}|[\u00df\u1e9e])" if part == "ss" else "".join(map(one, part)) for part in marker.replace("ss", "|ss|").split("|"))


MARKED = "(?:" + "|".join(map(_folded, SECRET_MARKERS)) + ")"
SECRET = f"{MARKED}=" + r"|(?:^|[^\p{L}\p{N}_])hf_[A-Za-z0-9]{16,}(?:$|[^\p{L}\p{N}_])"


def mapped_label(raw: Column, mapping: Mapping[str, str], skip: Mapping[str, str] | None = None) -> tuple[Column, Column]:
    """``(label, skip_reason)`` of a raw label: trimmed, lower-cased and looked up.

    A null is ``missing_label``, a value on neither list ``unsupported_label``; both have no label.
    """
    key = F.lower(F.btrim(raw, F.lit(" \t\r\n")))
    lookup = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[key] if m else F.lit(None)
    label = F.when(key.isNotNull(), lookup(mapping))
    reason = F.when(raw.isNull(), "missing_label").when(label.isNull(), F.coalesce(lookup(skip or {}), F.lit("unsupported_label")))
    return label, reason


def redacted(text: Column, longest: int = LONGEST_TEXT) -> Column:
    """A text with a secret or that is a local path gives a marker in its place, any other its first ``longest``
    characters; null stays null.  A secret is a marker word with ``=`` behind it, or an access token."""
    return (
        F.when(text.rlike(SECRET), REDACTED_SECRET).when(text.rlike(LOCAL_PATH), REDACTED_PATH).when(text.isNotNull(), F.substring(text, 1, longest))
    )


def sample_id(raw: Column, longest: int = LONGEST_ID) -> Column:
    """P10: redacted, cut and trimmed; null if nothing is left."""
    return F.nullif(F.btrim(redacted(raw, longest), F.lit(" \t\r\n\f\u000b")), F.lit(""))


def extension(fmt: Column, strict: bool = False) -> Column:
    """File extension of an image format; an unknown one gives its own letters and digits.  A format without any
    gives null, or with ``strict`` fails."""
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[F.upper(fmt)]
    own = F.nullif(F.regexp_replace(F.lower(fmt), "[^a-z0-9]", ""), F.lit(""))
    found = F.coalesce(known, own)
    return F.when(found.isNull(), F.raise_error(F.lit("image format has no safe extension"))).otherwise(found) if strict else found


def safe_path(path: Column) -> Column:
    """Whether a path of an archive stays inside it: not empty, relative, no colon, no backslash, no NUL, and no empty,
    ``.`` or ``..`` part but for slashes at the end.  Null is unsafe."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce(~path.startswith("/") & ~path.contains("\\") & ~path.contains(":") & ~path.contains("\x00") & ~bad, F.lit(False))


def contained_path(path: Column, folder: str, stem: Column | None = None) -> Column:
    """Whether a portable path is ``folder/name.extension``, nothing above or below, and has the ``stem`` asked for."""
    parts = F.split(path, "/")
    name = F.get(parts, 1)
    ok = (F.size(parts) == 2) & (F.get(parts, 0) == folder) & safe_path(path) & (name != "")
    if stem is not None:
        ok = ok & F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").eqNullSafe(stem)
    return F.coalesce(ok, F.lit(False))


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """``(first folder, base name, lower-case extension)``; the extension is null where there is none."""
    parts = F.split(path, "/")
    base = F.element_at(parts, -1)
    ext = F.nullif(F.regexp_extract(base, r"\.([A-Za-z0-9]+)$", 1), F.lit(""))
    return F.when(F.size(parts) > 1, F.get(parts, 0)), base, F.lower(ext)


def strict_bool(text: Column) -> Column:
    """True and false for exactly ``true`` and ``false``; anything else is null."""
    return F.when(text == "true", True).when(text == "false", False)


@F.pandas_udf(BooleanType())
def sensitive_state(state: pd.Series) -> pd.Series:
    """Whether a state, JSON text of any depth, has a key that a marker word is part of, or a text that is secret or a
    local path.  Null has none; text that is no JSON counts as sensitive, for it can't be looked into."""
    marked, secret, local = re.compile(MARKED), re.compile(SECRET.replace(r"\p{L}\p{N}_", r"\w")), re.compile(LOCAL_PATH)

    def bad(v: object) -> bool:
        if isinstance(v, dict):
            return any(marked.search(k) is not None or bad(x) for k, x in v.items())
        if isinstance(v, list):
            return any(map(bad, v))
        return isinstance(v, str) and (secret.search(v) is not None or local.match(v) is not None)

    def one(x: str | None) -> bool:
        try:
            return x is not None and bad(json.loads(x))
        except (ValueError, RecursionError):
            return True

    return state.map(one).astype(bool)


def number_or_nan(text: Column) -> Column:
    """Text as a number, NaN where it is none or null."""
    return F.coalesce(text.try_cast("double"), F.lit(float("nan")))


def component_path(component: Column, roots: Mapping[str, str], relative: Column) -> Column:
    """The path below the root of the row's component; a component without root fails when it runs."""
    root = F.create_map(*[F.lit(x) for kv in roots.items() for x in kv])[component]
    checked = F.coalesce(root, F.raise_error(F.concat(F.lit("unknown component: "), F.coalesce(component, F.lit("null")))).cast("string"))
    return F.concat_ws("/", checked, relative)


def source_group(dataset: Column, groups: Mapping[str, str]) -> Column:
    """The group of a dataset; one on no list fails when it runs."""
    found = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[dataset]
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown dataset: "), F.coalesce(dataset, F.lit("null")))).cast("string"))


def annotator_ok(name: Column) -> Column:
    """Whether a name of an annotator is letters, digits, underscore and hyphen only."""
    return F.coalesce(name.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))

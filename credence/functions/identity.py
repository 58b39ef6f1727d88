"""Names and fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the prefix of a fingerprint on the wire names its scheme.
SCHEME = "wlfp2"


def _digest(*parts: Column) -> Column:
    # concat_ws drops nulls, so every part is made a string first.
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def fingerprint(rule_id: Column, path: Column, qualname: Column, discriminator: Column) -> Column:
    return _digest(rule_id, path, qualname, discriminator)


def fingerprint_v0(rule_id: Column, path: Column, line: Column, qualname: Column, discriminator: Column) -> Column:
    """The older scheme, which also hashes the line."""
    return _digest(rule_id, path, line, qualname, discriminator)


def wire(digest: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}:"), digest)


def from_wire(value: Column) -> Column:
    """The digest of a wire fingerprint; null if the scheme or the form is another."""
    return F.when(value.rlike(f"^{SCHEME}:[0-9a-f]{{64}}$"), F.substring(value, len(SCHEME) + 2, 64))


def module_name(path: Column) -> Column:
    """Dotted module of a project-relative path: one leading ``src/``, ``.py`` and ``__init__`` go."""
    inner = F.regexp_replace(path, r"^src/", "")
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")
    return F.when(path.endswith(".py") & (dotted != ""), dotted)


def canonical_qualname(qualname: Column) -> Column:
    return F.regexp_replace(qualname, r":(setter|deleter)$", "")


def ancestors(qualname: Column) -> Column:
    """A dotted name and all its dotted prefixes."""
    parts = F.split(qualname, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def glob_pattern(glob: str) -> str:
    """A regular expression for a shell glob in which ``*`` crosses ``/``."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", at + 1)) > 0:
            body = glob[at:end].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[{'^' + body[1:] if body.startswith('!') else body}]"
            at = end + 1
        else:
            out += "\\" + c if c in ".^$+{}()|\\[]" else c
    return f"(?s)^{out}$"

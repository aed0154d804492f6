"""Label references in texts: ``{{ $labels.x }}``, ``{{ $value }}`` and ``{{x}}``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.model import label

_REFERENCE = re.compile(r"\{\{\s*(?:\$labels\.(\w+)|(\$value)|(\w+))\s*\}\}")


def render_text(template: str) -> Column:
    """The template with references replaced by the row's labels and value."""
    parts, at = [], 0
    for found in _REFERENCE.finditer(template):
        if found.start() > at:
            parts.append(F.lit(template[at : found.start()]))
        name = found.group(1) or found.group(3)
        parts.append(label(name) if name else F.col("value").cast("string"))
        at = found.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def render_map(templates: dict[str, str]) -> Column:
    if not templates:
        return F.create_map().cast("map<string,string>")
    flat = [x for name, text in templates.items() for x in (F.lit(name), render_text(text))]
    return F.create_map(*flat)

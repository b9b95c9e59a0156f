"""Images need a text for those who can't see them."""

import re

CATEGORY, SEVERITY = "quality", "warning"
IMAGE = re.compile(r"<img\b[^>]*>", re.IGNORECASE)


def check(text):
    for m in IMAGE.finditer(text):
        if not re.search(r"\salt\s*=", m[0], re.IGNORECASE):
            yield m.start(), "an image has no text — add alt"

"""Scripts belong in files of their own."""

import re

CATEGORY, SEVERITY = "security", "error"
SCRIPT = re.compile(r"<script>")


def check(text):
    for m in SCRIPT.finditer(text):
        yield m.start(), "a script stands in the page — move it to a file"

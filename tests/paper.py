"""A renderer of made-up PDF files: their text is %PDF, the number of pages, and a folder that gets a file for each page that is rendered, and for each time that one is opened."""

import uuid
from pathlib import Path


def renderer(content: bytes, dpi: int):
    kind, *rest = content.split(b" ", 3)
    if kind != b"%PDF":
        raise ValueError("not a PDF")
    count, folder = int(rest[0]), Path(rest[1].decode())
    (folder / f"open-{uuid.uuid4().hex}").touch()

    def page(i):
        if i == 6:
            raise ValueError("page 7 is broken")
        (folder / f"page-{i + 1}-{uuid.uuid4().hex}").touch()
        return b"png %d" % (i + 1), dpi, 2 * dpi

    return count, page

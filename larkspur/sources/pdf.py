"""PDF files, if the optional PyMuPDF library is there.

Lines and tables of a page are ordered by place; lines mostly inside a table, running
headers and footers go; bullets, headings and vertical gaps break paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from ..functions import rules as R
from .ooxml import Parsed, header_line, heading, markdown

GAP = 6.0


@dataclass(frozen=True)
class Item:
    """Something on a page, by its upper left corner and lower edge."""

    top: float
    left: float
    bottom: float
    kind: str
    text: str


def running_lines(pages: list[list[str]]) -> set[str]:
    """Lines near page edges that most pages share, and page numbers."""
    if len(pages) < 2:
        return set()
    counts = Counter(line for lines in pages for line in {x.strip() for x in [*lines[:3], *lines[-3:]]} if 4 <= len(line) <= 90 and any(map(str.isalnum, line)))
    least = max(2, int(len(pages) * 0.6))
    return {line for line, n in counts.items() if n >= least or re.match(R.PAGE_LINE, line)}


def is_bullet(text: str) -> bool:
    return text in R.BULLETS or 0 < len(text) <= 2 and not any(map(str.isalnum, text))


def page_blocks(items: list[Item], page: int) -> list[tuple[str, str, int, int | None]]:
    """Blocks of one page from its items."""
    out: list[tuple[str, str, int, int | None]] = []
    open_lines: list[str] = []
    bullet, bottom = False, None

    def close() -> None:
        if open_lines:
            out.append(("text", " ".join(open_lines).strip(), 0, page))
            open_lines.clear()

    for item in sorted(items, key=lambda i: (round(i.top, 1), i.left)):
        if item.kind == "table":
            close()
            out.append(("table", item.text, 0, page))
            bottom = None
            continue
        numbered = heading(item.text)
        if is_bullet(item.text):
            close()
            bullet = True
        elif numbered:
            close()
            out.append(("heading", numbered[1], numbered[0], page))
            bullet = False
        else:
            if bullet or bottom is not None and item.top - bottom > GAP:
                close()
            open_lines.append(f"- {item.text}" if bullet else item.text)
            bullet = False
        bottom = item.bottom
    close()
    return out


def parse_pdf(content: bytes, stem: str) -> Parsed:
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional PyMuPDF library") from e
    with pymupdf.open(stream=content, filetype="pdf") as doc:
        texts = [page.get_text() for page in doc]
        running = running_lines([[x for x in t.splitlines() if x.strip()] for t in texts])
        out, first = Parsed(plain="\n".join(texts), pages=doc.page_count), []
        for number, page in enumerate(doc, 1):
            tables = list(page.find_tables().tables)
            boxes = [pymupdf.Rect(t.bbox) for t in tables]
            items = [Item(b.y0, b.x0, b.y1, "table", m) for t, b in zip(tables, boxes, strict=True) if (m := markdown(t.extract()))]
            for block in page.get_text("dict")["blocks"]:
                for line in block.get("lines", []):
                    text, box = "".join(s["text"] for s in line["spans"]).strip(), pymupdf.Rect(line["bbox"])
                    covered = any((b & box).get_area() > 0.5 * box.get_area() for b in boxes if b.intersects(box))
                    if text and not covered and text not in running:
                        items.append(Item(box.y0, box.x0, box.y1, "line", text))
            if number == 1:
                first = [i.text for i in sorted(items, key=lambda i: (round(i.top, 1), i.left)) if i.kind == "line"][:10]
            out.blocks += page_blocks(items, number)
    title = next((x for x in first if not re.search(R.HEADER_HINT, x)), "")
    if title and out.blocks and out.blocks[0][0] == "text" and out.blocks[0][1].startswith(title):
        rest = out.blocks[0][1][len(title) :].strip()
        out.blocks[:1] = [("title", title, 0, 1), *([("text", rest, 0, 1)] if rest else [])]
    out.title, out.header = title or stem, header_line(first)
    return out

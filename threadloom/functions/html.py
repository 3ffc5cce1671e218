"""One pass over the markup of a page.  A small per-row helper used inside ``parse_pages``."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template", "noscript"}
GROUP_HEADINGS = {"h2", "h3", "h4"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li"}


#: What can be read from a page.
PARTS = ("title", "text", "paragraphs", "tables", "groups", "markdown")


class PageReader(HTMLParser):
    """Collects the wanted parts: title, text, paragraphs, tables, what follows headings (groups), and markdown blocks.

    A new paragraph, list item, cell or row closes an open one, as browsers do.
    """

    def __init__(self, parts=PARTS):
        super().__init__(convert_charrefs=True)
        self._wants_text, self._wants_tables, self._wants_groups = "text" in parts, "tables" in parts, "groups" in parts
        self._wants_paragraphs, self._wants_blocks = "paragraphs" in parts, "markdown" in parts
        self.title, self.texts, self.paragraphs, self.tables, self.groups, self.blocks = "", [], [], [], [], []
        self._hidden = 0
        self._in_title = False
        self._paragraph = None
        self._open_tables = []
        self._block = None
        self._link = None
        self._heading = None
        self._group = None

    # -- markup events
    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self._hidden += 1
        elif tag == "title":
            self._in_title = True
        if self._wants_tables:
            self._table_start(tag)
        if self._wants_groups:
            self._group_start(tag)
        if tag == "p" and self._wants_paragraphs:
            self._end_paragraph()
            self._paragraph = []
        if not self._wants_blocks:
            return
        if tag in BLOCKS:
            self._end_block()
            self._block = (tag, [])
        if tag == "a":
            self._link = (dict(attrs).get("href"), [])

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        elif tag == "title":
            self._in_title = False
        if tag == "p":
            self._end_paragraph()
        if self._wants_blocks:
            if tag == "a":
                self._end_link()
            if tag in BLOCKS:
                self._end_block()
        if self._open_tables:
            self._table_end(tag)
        if self._wants_groups:
            self._group_end(tag)

    def handle_data(self, data):
        if self._in_title:
            self.title += data
            return
        text = data.strip()
        if self._hidden or not text:
            return
        if self._wants_text:
            self.texts.append(text)
        if self._paragraph is not None:
            self._paragraph.append(text)
        if self._link is not None:
            self._link[1].append(text)
        elif self._block is not None:
            self._block[1].append(text)
        if self._open_tables and self._open_tables[-1]["cell"] is not None:
            self._open_tables[-1]["cell"][1].append(text)
        if self._heading is not None:
            self._heading.append(text)
        elif self._group is not None:
            self._group["text"].append(data)
            if self._group["items"]:
                self._group["items"][-1].append(text)

    def close(self):
        super().close()
        self._end_paragraph()
        self._end_link()
        self._end_block()
        while self._open_tables:
            self._end_table()
        self._end_group()

    # -- parts
    def _end_paragraph(self):
        if self._paragraph:
            self.paragraphs.append(" ".join(self._paragraph))
        self._paragraph = None

    def _end_link(self):
        if self._link is not None and self._block is not None:
            href, words = self._link
            label = " ".join(words)
            self._block[1].append(f"[{label}]({href})" if href and label else label)
        self._link = None

    def _end_block(self):
        if self._block is not None:
            tag, words = self._block
            line = " ".join(w for w in words if w)
            if line:
                prefix = "- " if tag == "li" else "" if tag == "p" else "#" * int(tag[1]) + " "
                self.blocks.append(prefix + line)
        self._block = None

    def _table_start(self, tag):
        if tag == "table":
            self._open_tables.append({"headers": [], "rows": [], "row": None, "cell": None})
        elif self._open_tables and tag in ("tr", "td", "th"):
            self._end_cell()
            if tag == "tr":
                self._end_row()
                self._open_tables[-1]["row"] = []
            else:
                self._open_tables[-1]["cell"] = (tag, [])

    def _table_end(self, tag):
        if tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_cell()
            self._end_row()
        elif tag == "table":
            self._end_table()

    def _end_cell(self):
        table = self._open_tables[-1]
        if table["cell"] is not None:
            kind, words = table["cell"]
            text = " ".join(words)
            if kind == "th":
                table["headers"].append(text)
            elif table["row"] is None:
                table["row"] = [text]
            else:
                table["row"].append(text)
        table["cell"] = None

    def _end_row(self):
        table = self._open_tables[-1]
        if table["row"]:
            table["rows"].append(table["row"])
        table["row"] = None

    def _end_table(self):
        self._end_cell()
        self._end_row()
        table = self._open_tables.pop()
        if table["rows"]:
            self.tables.append({"headers": table["headers"], "rows": table["rows"]})

    def _group_start(self, tag):
        if tag in GROUP_HEADINGS:
            self._end_group()
            self._heading = []
        elif self._group is not None and tag not in VOID:
            if self._group["list"] is None:
                self._group["list"] = tag if tag in ("ul", "ol") else ""
            if self._group["list"] and tag == "li":
                self._group["items"].append([])

    def _group_end(self, tag):
        if tag in GROUP_HEADINGS and self._heading is not None:
            self._group = {"heading": " ".join(self._heading), "list": None, "items": [], "text": []}
            self._heading = None
        elif self._group is not None and self._group["list"] and tag == self._group["list"]:
            self._end_group()

    def _end_group(self):
        group, self._group = self._group, None
        if group is None:
            return
        if group["list"]:
            items = [" ".join(words) for words in group["items"]]
        else:
            joined = "".join(group["text"])
            for mark in ";\n":
                joined = joined.replace(mark, ",")
            items = [part.strip() for part in joined.split(",")]
        items = [item for item in items if item]
        if items:
            self.groups.append({"heading": group["heading"], "items": items})


#: A tag without attributes.
BARE_TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*)>")
#: Elements whose content some versions of the parser read as text.
RAW = {"script", "style", "textarea", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript"}


def _feed_bare(reader: PageReader, html: str) -> bool:
    """Send the events of a page whose tags are all bare; False, and no event, for any other page."""
    pieces = BARE_TAG.split(html)
    if html.count("<") != len(pieces) // 2:
        return False
    tags = [tag.lower() for tag in pieces[1::2]]
    known = set(tags)
    if not known.isdisjoint(RAW):
        return False
    if "title" in known and any(tag == "title" and after != "/title" for tag, after in zip(tags, [*tags[1:], ""])):
        return False
    start, end, data = reader.handle_starttag, reader.handle_endtag, reader.handle_data
    if pieces[0]:
        data(unescape(pieces[0]))
    for tag, text in zip(tags, pieces[2::2]):
        if tag[0] == "/":
            end(tag[1:])
        else:
            start(tag, ())
        if text:
            data(unescape(text) if "&" in text else text)
    return True


def read_page(html: str, parts=PARTS) -> PageReader:
    reader = PageReader(parts)
    html = html or ""
    # a page without a table needs no parser for its tables
    if tuple(parts) != ("tables",) or "<table" in html.lower():
        # the parser spends most of its time on what bare tags do not have
        if not _feed_bare(reader, html):
            reader.feed(html)
    reader.close()
    return reader

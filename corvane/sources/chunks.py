"""Chunks of texts and groups of rows, as table functions that are joined laterally or fed a partition in order."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import importable

# What texts are split at, first things first; markdown at its headings, fences and rules before. White space that chunks lose at their ends.
PLAIN = ("\n\n", "\n", " ", "")
MARKDOWN = ("\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "```\n\n", "\n\n***\n\n", "\n\n---\n\n", "\n\n___\n\n", *PLAIN)
WHITE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SIZE, OVERLAP = 1000, 200


def _merged(pieces: list[str], glue: str, size: int, overlap: int) -> Iterator[str]:
    """Pieces joined to chunks of at most ``size``; a chunk begins with the last pieces of the one before, as far as ``overlap`` and room for the next piece allow."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        room = size - len(piece)
        if window and held + len(window) * len(glue) > room:
            yield glue.join(window)
            while held and (held > overlap or held + len(window) * len(glue) > room):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        yield glue.join(window)


def _split(text: str, marks: tuple[str, ...], size: int, overlap: int, keep: bool) -> Iterator[str]:
    at = next(i for i, m in enumerate(marks) if m in text)
    mark = marks[at]
    if not mark:
        pieces = list(text)
    elif keep:
        pieces = re.split(f"(?={re.escape(mark)})", text)
    else:
        pieces = text.split(mark)
    glue, waiting = "" if keep else mark, []
    for piece in pieces:
        if not piece:
            continue
        if len(piece) < size:
            waiting.append(piece)
            continue
        yield from _merged(waiting, glue, size, overlap)
        waiting = []
        yield from _split(piece, marks[at + 1 :], size, overlap, keep) if mark else (piece,)
    yield from _merged(waiting, glue, size, overlap)


def chunks_of(text: str | None, extension: str = "", size: int = SIZE, overlap: int = OVERLAP) -> Iterator[str]:
    """The chunks of a text: split at the first mark that it holds, pieces that are too long at the next ones, and merged again.

    Marks stay at the head of what follows them; in markdown they go where a chunk begins. Lengths count code points.
    """
    if text:
        markdown = extension.lower() in (".md", ".markdown")
        for chunk in _split(text, MARKDOWN if markdown else PLAIN, size, overlap, not markdown):
            if chunk := chunk.strip(WHITE):
                yield chunk


def chunked(df: DataFrame, text: str = "text", extension: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each chunk in place of each text: ``chunk_index`` and ``chunk``. Texts without any, and null ones, give none."""
    importable(df.sparkSession)

    @F.udtf(returnType="chunk_index int, chunk string")
    class Chunks:
        def eval(self, body: str, suffix: str):  # noqa: ANN202
            yield from enumerate(chunks_of(body, suffix or "", size, overlap))

    rows = df.lateralJoin(Chunks(F.col(text).outer(), F.col(extension).outer() if extension else F.lit("")))
    return rows.drop(text)


def grouped_rows(lines: DataFrame, group: str, order: str, line: str, head: int, size: int = SIZE) -> DataFrame:
    """(group, part, first, last, text) of lines in order: a part takes lines as long as its head of ``head`` characters and they fit into ``size``, and one at least.

    Lines of a group are read in order and held one part at a time.
    """
    importable(lines.sparkSession)
    kind = lines.schema[group].dataType.simpleString()

    @F.udtf(returnType=f"`{group}` {kind}, part int, first long, last long, text string")
    class Parts:
        def __init__(self) -> None:
            self.part, self.first, self.key, self.held, self.length, self.n = 0, 1, None, [], head, 0

        def close(self):  # noqa: ANN202
            yield self.key, self.part, self.first, self.n, "\n".join(self.held)

        def eval(self, row):  # noqa: ANN001, ANN202
            body = row[line]
            if self.held and self.length + 1 + len(body) > size:
                yield from self.close()
                self.part, self.first, self.held, self.length = self.part + 1, self.n + 1, [], head
            self.length += len(body) + (1 if self.held else 0)
            self.held.append(body)
            self.key, self.n = row[group], self.n + 1

        def terminate(self):  # noqa: ANN202
            if self.held:
                yield from self.close()

    return Parts(lines.select(group, order, line).asTable().partitionBy(group).orderBy(order))

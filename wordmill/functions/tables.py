"""Table functions for SQL: texts and encoded utterances cut to a budget.

    register(spark)
    SELECT d.doc_id, c.* FROM documents d, LATERAL text_chunks(d.text, 40) c
    SELECT u.id, c.* FROM utterances u, LATERAL token_chunks(u.tokens, u.ids, u.tones, 200) c
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Characters after which a text is cut first and next.
SENTENCE_ENDS, CLAUSE_ENDS = ".!?", ",;:"
#: Tokens after which an utterance is cut first and next, what stands between words, and marks that end a tone.
STRONG, WEAK, BETWEEN, TONES = frozenset(".!?。！？…"), frozenset(",;:，；：、"), "_", "ˉˊˇˋ˙"


def packed(pieces: list[list[str]], budget: int) -> Iterator[list[str]]:
    """Neighbouring pieces joined as long as they fit; a longer piece is alone."""
    held: list[str] = []
    for piece in pieces:
        if held and len(held) + len(piece) > budget:
            yield held
            held = []
        held = held + piece
    if held:
        yield held


def pieces_after(words: list[str], marks: str) -> list[list[str]]:
    """The words cut after each that ends in a mark."""
    out: list[list[str]] = [[]]
    for word in words:
        out[-1].append(word)
        if word[-1] in marks:
            out.append([])
    return [piece for piece in out if piece]


def text_parts(words: list[str], budget: int) -> Iterator[tuple[list[str], bool]]:
    """(words, hard) of at most `budget` words: cut after sentence ends, where a sentence is too long after clause ends, else anywhere (hard)."""
    for sentences in packed(pieces_after(words, SENTENCE_ENDS), budget):
        if len(sentences) <= budget:
            yield sentences, False
            continue
        clauses = pieces_after(sentences, CLAUSE_ENDS)
        if max(map(len, clauses)) <= budget:
            yield from ((part, False) for part in packed(clauses, budget))
        else:
            yield from ((sentences[at : at + budget], True) for at in range(0, len(sentences), budget))


def token_ends(tokens: list[str], budget: int) -> Iterator[tuple[int, str]]:
    """(end, kind) of the chunks of an utterance: the last strong, weak, word or tone boundary within the budget, in this order of choice.

    A separator after a strong or weak boundary goes with it if it fits. kind is none, and the chunk ends
    at the budget, where there is no boundary at all.
    """
    start = 0
    while len(tokens) - start > budget:
        last: dict[str, int] = {}
        for at in range(start, start + budget):
            token = tokens[at]
            if token in STRONG or token in WEAK:
                takes_next = at + 1 < start + budget and tokens[at + 1] == BETWEEN
                last["strong" if token in STRONG else "weak"] = at + 1 + takes_next
            elif token == BETWEEN and at > start:
                last["word"] = at + 1
            elif token[-1:] in TONES and token:
                last["tone"] = at + 1
        kind = next((k for k in ("strong", "weak", "word", "tone") if k in last), "none")
        start = last.get(kind, start + budget)
        yield start, kind
    yield len(tokens), "end"


@udtf(returnType="chunk int, n_chunks int, n_words int, hard boolean, part string")
class TextChunks:
    """text_chunks(text, budget): no row for a null or blank text; joined by spaces the parts give the text's words again."""

    def eval(self, text: str, budget: int) -> Iterator[tuple]:
        if budget is None or budget < 1:
            raise ValueError("the budget is one word at least")
        parts = list(text_parts((text or "").split(), budget))
        for number, (words, hard) in enumerate(parts):
            yield number, len(parts), len(words), hard, " ".join(words)


@udtf(returnType="chunk int, tokens array<string>, ids array<int>, tones array<int>, cut string")
class TokenChunks:
    """token_chunks(tokens, ids, tones or null, budget): arrays cut alike; arrays of other lengths are an error."""

    def eval(self, tokens: list, ids: list, tones: list, budget: int) -> Iterator[tuple]:
        if not tokens:
            return
        if budget is None or budget < 1 or ids is None or len(ids) != len(tokens) or (tones is not None and len(tones) != len(tokens)):
            raise ValueError("tokens, ids and tones have one length, the budget is one token at least")
        tokens, start = [t or "" for t in tokens], 0
        for number, (end, kind) in enumerate(token_ends(tokens, budget)):
            yield number, tokens[start:end], list(ids[start:end]), None if tones is None else list(tones[start:end]), kind
            start = end


def register(spark: SparkSession) -> None:
    """Makes text_chunks and token_chunks known to a session's SQL."""
    spark.udtf.register("text_chunks", TextChunks)
    spark.udtf.register("token_chunks", TokenChunks)

"""Piece models: reading ``.model`` files as plain lists."""

from __future__ import annotations

from dataclasses import dataclass

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool

    @property
    def normal(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}


def load(path: str) -> PieceModel:
    """Pieces, scores and kinds of a model, and whether its scores are merge ranks (BPE) or log-probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    kinds = [UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) else BYTE if sp.is_byte(i) else NORMAL for i in range(n)]
    scores = [sp.get_score(i) for i in range(n)]
    # merge ranks are whole negative numbers
    bpe = all(float(s).is_integer() for s, k in zip(scores, kinds) if k == NORMAL)
    return PieceModel([sp.id_to_piece(i) for i in range(n)], scores, kinds, bpe)

"""Settings of the engine, as one frozen value that the caller makes and passes on."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions import rules as R


@dataclass(frozen=True)
class Settings:
    profile: str = "improved"
    retrieve_top_k: int = R.RETRIEVE_TOP_K
    context_top_k: int = R.CONTEXT_TOP_K
    baseline_top_k: int = R.BASELINE_TOP_K
    min_relevance: float = R.MIN_RELEVANCE
    max_context_chars: int = R.MAX_CONTEXT_CHARS
    window_chars: int = R.WINDOW_CHARS
    embed_width: int = R.EMBED_WIDTH

    @property
    def baseline(self) -> bool:
        return self.profile == "baseline"

"""What a redaction does: layers, custom words, how occurrences and output are treated."""

from __future__ import annotations

from dataclasses import dataclass

from .functions.lexicon import ORGS, PUBLIC_COMPANIES
from .functions.rules import RULES, Rule


@dataclass(frozen=True)
class RedactConfig:
    regex: bool = True
    gazetteer: bool = True
    contextual: bool = True
    names: bool = True
    #: all: every occurrence of a value becomes its token; first: the first one only
    occurrence: str = "all"
    #: token: [TYPE_n]; phantom: a made-up value; redacted: [redacted]
    mode: str = "token"
    org_confidence: float = 0.7
    confidence: float = 0.5
    extra_orgs: tuple[str, ...] = ()
    extra_whitelist: tuple[str, ...] = ()
    public_companies: tuple[str, ...] = PUBLIC_COMPANIES

    @property
    def rules(self) -> tuple[Rule, ...]:
        """The rules of the layers that are on, in their order."""
        layers = {"L1b": self.gazetteer, "L1.5": self.regex, "L3": self.regex, "L3.5": self.regex, "L5": self.contextual}
        return tuple(r for r in RULES if layers[r.layer])

    @property
    def orgs(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(ORGS + self.extra_orgs)) if self.gazetteer else ()


def strict() -> RedactConfig:
    """Takes less certain entities of a recogniser too."""
    return RedactConfig(org_confidence=0.5, confidence=0.3)

"""What adapters give, and the scope in which names get their targets."""

from __future__ import annotations

from dataclasses import dataclass, field

MODULE = "<module>"


@dataclass
class Symbol:
    kind: str
    path: str
    line: int
    end_line: int
    is_test: bool = False
    is_default_export: bool = False
    is_abstract: bool = False
    owner: str | None = None
    signature: str | None = None
    contract_kind: str | None = None


@dataclass
class Ref:
    source: str
    name: str
    kind: str = "Calls"
    tag: str = "Opaque"
    module: str = ""


@dataclass
class ContractRef:
    kind: str
    contract_id: str
    symbol: str
    role: str


@dataclass
class Extract:
    symbols: list[Symbol] = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)
    contracts: list[ContractRef] = field(default_factory=list)
    generated: bool = False


class Scope:
    """Names of one file: default imports, imports, own declarations, wildcard imports, then the language's fallback."""

    def __init__(self, module: str, fallback: tuple[str, str] = ("Opaque", "")):
        self.module, self.fallback = module, fallback
        self.imports: dict[str, str] = {}
        self.defaults: dict[str, str] = {}
        self.aliases: dict[str, str] = {}
        self.locals: set[str] = set()
        self.wildcards: list[str] = []

    def original(self, name: str) -> str:
        return self.aliases.get(name, name)

    def bare(self, name: str) -> tuple[str, str]:
        if name in self.defaults:
            return "ModuleDefault", self.defaults[name]
        if name in self.imports:
            return "Module", self.imports[name]
        if name in self.locals:
            return "Module", self.module
        if len(self.wildcards) == 1:
            return "Module", self.wildcards[0]
        return self.fallback

    def qualified(self, qualifier: str) -> tuple[str, str]:
        if qualifier in self.imports:
            return "Module", self.imports[qualifier]
        if qualifier in self.locals:
            return "Module", self.module
        return "Opaque", ""

    def known(self, name: str) -> bool:
        return name in self.imports or name in self.defaults or name in self.locals


def join(*parts: str) -> str:
    return "::".join(p for p in parts if p)

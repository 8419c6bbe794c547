"""Brace languages by a tolerant lexer: Rust, TypeScript/JavaScript, Go, Kotlin, Swift, C++.

Comments and string contents are blanked first (places stay), then declarations
are found by pattern and their extents by matching braces.  This covers the
constructs listed in the README, not whole grammars; unknown text is skipped.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from dataclasses import dataclass

from ..functions.sqltext import quoted_rule_tables, unescape_go
from .base import MODULE, ContractRef, Extract, Ref, Scope, Symbol, join

#: Words in front of a parenthesis that call nothing.
KEYWORDS = frozenset("if for while switch match return catch fn func function fun class struct enum when guard in as new delete sizeof typeof await async throw yield else do let var const import export super init constructor where impl trait interface type defer case static_assert decltype alignof noexcept operator".split())
#: Global namespaces of scripts whose member calls resolve to nothing, and call helpers.
SCRIPT_GLOBALS = frozenset("console Math JSON Object Array String Number Boolean Promise Symbol Reflect Proxy Date RegExp Error Map Set WeakMap WeakSet Intl process Buffer window document globalThis".split())
CALL_HELPERS = frozenset(("apply", "call", "bind"))
GO_VERBS = frozenset("GET HEAD POST PUT PATCH DELETE CONNECT OPTIONS TRACE".split())

_BLANK = re.compile(
    r"""//[^\n]*|/\*.*?(?:\*/|\Z)|r(\#+)".*?"\1|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|'(?:\\(?:u\{[^}]*\}|.)|[^'\\\n])'""", re.S
)
_SCRIPT_BLANK = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_IDENT = r"[^\W\d]\w*"
_CALL = re.compile(rf"(?<![\w$])({_IDENT}(?:\s*(?:::|\?\.|->|\.)\s*{_IDENT})*)\s*!?\s*(?:(?:::)?<[\w\s,:<>&\[\]']*>)?\s*\(")


@dataclass
class Decl:
    symbol: Symbol
    start: int
    body: int
    end: int


class Source:
    """A file's text with comments and strings blanked, line numbers and brace extents."""

    def __init__(self, text: str, script: bool = False):
        self.text = text
        self.literals: list[tuple[int, str]] = []

        def blank(m: re.Match) -> str:
            s = m[0]
            if s.startswith(("//", "/*")):
                return re.sub(r"[^\n]", " ", s)
            self.literals.append((m.start(), s))
            inner = re.sub(r"[^\n]", " ", s[1:-1])
            return f'"{inner}"' if len(s) > 1 else s

        self.bare = (_SCRIPT_BLANK if script else _BLANK).sub(blank, text)
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.at = [p for p, _ in self.literals]

    def line(self, pos: int) -> int:
        return bisect.bisect_left(self.lines, pos) + 1

    def close(self, opened: int, pair: str = "{}") -> int:
        """Place of the brace that closes the one at opened (the end when none does)."""
        depth = 0
        for m in re.compile("[" + re.escape(pair) + "]").finditer(self.bare, opened):
            depth += 1 if m[0] == pair[0] else -1
            if depth == 0:
                return m.start()
        return len(self.bare)

    def literal(self, start: int, end: int) -> str | None:
        """The first string's inside between two places."""
        i = bisect.bisect_left(self.at, start)
        if i < len(self.at) and self.at[i] < end:
            s = self.literals[i][1]
            return re.sub(r'^r#+"|"#+$', "", s) if s.startswith("r#") else s[1:-1]
        return None

    def body_of(self, pos: int) -> tuple[int, int]:
        """Braces of the declaration whose head ends at pos, or (end of statement, same) without a body."""
        m = re.compile(r"[{;]").search(self.bare, pos)
        if not m or m[0] == ";":
            end = m.start() if m else len(self.bare)
            return end, end
        return m.start(), self.close(m.start())


def _params(src: Source, pos: int) -> tuple[str, int]:
    """Text inside the parentheses at or after pos, and where they close."""
    opened = src.bare.find("(", pos)
    closed = src.close(opened, "()") if opened >= 0 else pos
    return src.bare[opened + 1 : closed], closed


def _owner(decls: list[Decl], pos: int, kinds: tuple[str, ...] = ("Function", "Field")) -> Decl | None:
    inside = [d for d in decls if d.start <= pos <= d.end and d.symbol.kind in kinds]
    return max(inside, key=lambda d: d.start, default=None)


def _defines(src: Source, opened: int) -> bool:
    """Whether the parentheses at a place are a method's parameters: a body follows them, as in object literals (proxy traps, too)."""
    return re.compile(r"\s*(?::[^;{}()=]*)?\{").match(src.bare, src.close(opened, "()") + 1) is not None


def _collect(src: Source, out: Extract, decls: list[Decl], scope: Scope, module: str, script: bool, target: Callable[[list[str], Decl | None], Ref | None]) -> None:
    """Calls, attributed to the innermost function (scripts: else to the module)."""
    heads = {d.symbol.path.rsplit("::", 1)[-1]: d for d in decls}
    for m in _CALL.finditer(src.bare):
        parts = re.split(r"\s*(?:::|\?\.|->|\.)\s*", m[1])
        if parts[-1] in KEYWORDS or parts[0] in ("return", "await", "new", "throw") and len(parts) == 1:
            continue
        owner = _owner(decls, m.start())
        name_at = m.start(1) + len(m[1]) - len(parts[-1])
        if owner and parts[-1] in heads and any(d.start <= name_at < (d.body if d.body > d.start else d.start + 1) and d.symbol.path.endswith(f"::{parts[-1]}") and re.search(rf"\b{re.escape(parts[-1])}\s*$", src.bare[d.start : m.end(1)]) and not re.search(r"[={]", src.bare[d.start : name_at]) for d in decls):
            continue
        if owner is None and not script or script and len(parts) == 1 and _defines(src, m.end() - 1):
            continue
        ref = target(parts, owner)
        if ref:
            ref.source = owner.symbol.path if owner else join(module, MODULE)
            out.refs.append(ref)


# ---- Rust ----

_RUST_ITEM = re.compile(rf"\b(fn|struct|enum|trait|mod|impl)\b\s*(?:<[^{{;]*?>\s*(?={_IDENT}))?([^{{;(]*)")


def _use_tree(text: str, base: list[str], scope: Scope, crate: str) -> None:
    text = text.strip()
    if "{" in text:
        head, _, rest = text.partition("{")
        inner = rest[: rest.rfind("}")]
        prefix = base + [p for p in head.split("::") if p.strip()]
        depth, part = 0, ""
        for c in inner + ",":
            if c == "," and depth == 0:
                if part.strip():
                    _use_tree(part, prefix, scope, crate)
                part = ""
                continue
            depth += {"{": 1, "}": -1}.get(c, 0)
            part += c
        return
    path, _, alias = (x.strip() for x in text.partition(" as "))
    seg = base + [p.strip() for p in path.split("::") if p.strip()]
    if not seg:
        return
    here = crate.split("::") if crate else []
    if seg[0] == "crate":
        seg = seg[1:]
    elif seg[0] == "self":
        seg = here + seg[1:]
    else:
        up = here
        while seg and seg[0] == "super":
            up, seg = up[:-1], seg[1:]
            if not seg or seg[0] != "super":
                seg = up + seg
    if not seg:
        return
    if seg[-1] == "*":
        scope.wildcards.append("::".join(seg[:-1]))
    elif seg[-1] == "self":
        scope.imports[alias or seg[-2]] = "::".join(seg[:-2])
    else:
        scope.imports[alias or seg[-1]] = "::".join(seg[:-1])


#: Place of a name's type in Rust: annotated bindings, constructors by path, struct values, unit values.
_RUST_BINDING = re.compile(rf"\blet\s+(?:mut\s+)?({_IDENT})\s*(?::\s*([^=;]+?))?\s*=\s*(?:&\s*(?:mut\s+)?)?((?:{_IDENT}::)*{_IDENT})?")


def _rust_type(text: str) -> str | None:
    """The type a declaration names, within references and containers: Repo of &mut Repo, Arc<Repo> or Option<Box<x::Repo>>."""
    head, opened, rest = text.partition("<")
    inner = _rust_type(rest.rsplit(">", 1)[0].split(",")[0]) if opened else None
    names = re.findall(r"(?<!')\b[A-Z]\w*", head)
    return inner or (names[-1] if names else None)


def _rust_named(text: str) -> dict[str, str]:
    """Names and types of a list of fields or parameters; commas within brackets part nothing."""
    depth, part, parts = 0, "", []
    for c in text.replace("->", "  ") + ",":
        if c == "," and depth <= 0:
            parts.append(part)
            part = ""
            continue
        depth += (c in "<([") - (c in ">)]")
        part += c
    named = [re.search(rf"({_IDENT})\s*:(?!:)(.*)", p, re.S) for p in parts]
    return {m[1]: _rust_type(m[2]) or "" for m in named if m}


def _rust_receivers(src: Source, decls: list[Decl]) -> tuple[dict[int, dict[str, str]], dict[tuple[str, str], str]]:
    """Types of bindings by function (its start) and name, and of fields by struct and name."""
    bindings: dict[int, dict[str, str]] = {}
    fields: dict[tuple[str, str], str] = {}
    for d in decls:
        if d.start < 0 or d.body >= d.end:
            continue
        if d.symbol.kind == "Function":
            known = bindings[d.start] = _rust_named(_params(src, d.start)[0])
            for m in _RUST_BINDING.finditer(src.bare, d.body, d.end):
                value = (m[3] or "").split("::")
                after = src.bare[m.end() :].lstrip()[:1]
                made = value[-2] if len(value) > 1 and after == "(" else value[-1] if after in ("{", ";") else ""
                known[m[1]] = (_rust_type(m[2]) if m[2] else made if made[:1].isupper() else None) or ""
        elif d.symbol.kind == "Type":
            owner = d.symbol.path.rsplit("::", 1)[-1]
            fields |= {(owner, name): typed for name, typed in _rust_named(src.bare[d.body + 1 : d.end]).items()}
    return bindings, fields


def rust(file: str, module: str, text: str, config: dict | None = None) -> Extract:
    config = config or {}
    src, out, decls, scope = Source(text), Extract(), [], Scope(module)
    for m in re.finditer(r"\b(?:pub\s*(?:\([^)]*\)\s*)?)?use\s+([^;]+);", src.bare):
        _use_tree(re.sub(r"\s+", " ", m[1]), [], scope, module)
    spans: list[tuple[int, int, str, str]] = []  # modules, impls and traits around functions
    events = set()
    for m in _RUST_ITEM.finditer(src.bare):
        kind, head = m[1], m[2].strip()
        name = re.match(_IDENT, head)
        around = [s for s in spans if s[0] <= m.start() <= s[1]]
        prefix = join(module, *[s[2] for s in around if s[3] == "mod"])
        if kind == "impl":
            body, end = src.body_of(m.end())
            whole = src.bare[m.start() : body]
            trait, _, typed = whole.partition(" for ")
            owner = re.search(rf"({_IDENT})\s*(?:<[^{{]*>)?\s*(?:where\b.*)?$", (typed or re.sub(r"^impl\s*(?:<[^>]*>)?", "", whole)).strip(), re.S)
            if owner:
                spans.append((m.start(), end, owner[1], "impl"))
                if typed and config.get("event_strategy", "marker_trait") == "marker_trait" and re.search(rf"\b{config.get('event_marker_trait', 'DomainEvent')}\b", trait):
                    events.add((join(prefix, owner[1]), src.line(m.start())))
            continue
        if not name:
            continue
        body, end = src.body_of(m.end())
        first, last = src.line(m.start()), src.line(end)
        if kind == "mod":
            if body != end:
                spans.append((m.start(), end, name[0], "mod"))
        elif kind == "fn":
            owner = next((s[2] for s in reversed(around) if s[3] in ("impl", "trait")), None)
            attrs = src.bare[max(0, src.bare.rfind("}", 0, m.start()), src.bare.rfind(";", 0, m.start())) : m.start()]
            test = re.search(r"#\[\s*(?:tokio::|async_std::)?test\b", attrs) is not None
            if owner is None or around[-1][3] != "trait":
                decls.append(Decl(Symbol("Function", join(prefix, owner or "", name[0]), first, last, is_test=test, owner=owner), m.start(), body, end))
        else:
            decls.append(Decl(Symbol("Trait" if kind == "trait" else "Type", join(prefix, name[0]), first, last), m.start(), body, end))
            scope.locals.add(name[0])
            if kind == "trait":
                spans.append((m.start(), end, name[0], "trait"))
            if kind == "enum" and body != end:
                depth_text = re.sub(r"\([^()]*\)|\{[^{}]*\}|#\[[^\]]*\]", lambda x: re.sub(r"[^\n]", " ", x[0]), src.bare[body + 1 : end])
                for v in re.finditer(rf"(?:^|,)\s*({_IDENT})", depth_text):
                    at = src.line(body + 1 + v.start(1))
                    decls.append(Decl(Symbol("Field", join(prefix, name[0], v[1]), at, at), -1, -1, -2))
            if kind in ("struct", "enum") and config.get("event_strategy") == "naming_suffix" and name[0].endswith(config.get("event_naming_suffix", "Event")):
                events.add((join(prefix, name[0]), first))
    scope.locals |= {d.symbol.path.removeprefix(f"{module}::" if module else "").split("::")[0] for d in decls if d.symbol.kind == "Function" and not d.symbol.owner}

    bindings, fields = _rust_receivers(src, decls)

    def target(parts: list[str], owner: Decl | None) -> Ref | None:
        if parts[0] == "self" and len(parts) == 2 and owner and owner.symbol.owner:
            return Ref("", f"{owner.symbol.owner}::{parts[1]}", tag="Module", module=module)
        if len(parts) == 1:
            return Ref("", parts[0], "Calls", *scope.bare(parts[0]))
        head, name = parts[-2], parts[-1]
        typed = None
        if owner and parts[0] == "self" and len(parts) == 3:
            typed = fields.get((owner.symbol.owner or "", head))
        elif owner and len(parts) == 2:
            typed = bindings.get(owner.start, {}).get(head)
        if typed:
            tag, where = scope.qualified(typed)
            if tag == "Module":
                return Ref("", f"{typed}::{name}", "Calls", tag, where)
        if head == "Self" and owner and owner.symbol.owner:
            return Ref("", f"{owner.symbol.owner}::{name}", tag="Module", module=module)
        if parts[0] in ("crate", "self", "super"):
            probe = Scope(module)
            _use_tree("::".join(parts), [], probe, module)
            return Ref("", name, tag="Module", module=probe.imports.get(name, ""))
        tag, where = scope.qualified(parts[0])
        if tag == "Module":
            return Ref("", f"{head}::{name}", "Calls", tag, where) if head[:1].isupper() else Ref("", name, "Calls", tag, join(where, *parts[:-1]))
        return Ref("", f"{head}::{name}" if head[:1].isupper() else name)

    _collect(src, out, decls, scope, module, False, target)
    for m in re.finditer(rf"\b({_IDENT})::({_IDENT})\b(?!\s*(?:::|\(|!))", src.bare):
        owner = _owner(decls, m.start(), ("Function",))
        if owner and m[1][:1].isupper() and m[2][:1].isupper():
            tag, where = scope.qualified(m[1])
            out.refs.append(Ref(owner.symbol.path, f"{m[1]}::{m[2]}", "References", tag if tag == "Module" else "Unscoped", where))
    for d in [d for d in decls if d.symbol.kind == "Function"]:
        params, closed = _params(src, d.start)
        for t in re.finditer(rf"\b([^\W\d_a-z]\w*)\b", params + src.bare[closed + 1 : d.body]):
            out.refs.append(Ref(d.symbol.path, t[1], "References", *scope.bare(t[1])))
        for t in re.finditer(rf":\s*&?\s*(?:mut\s+)?({_IDENT})", params):
            out.contracts.append(ContractRef("Event", t[1], d.symbol.path, "consumes"))
        for t in re.finditer(rf"(?<![\w.])([A-Z]\w*)\s*\{{", src.bare[d.body + 1 : d.end]):
            out.contracts.append(ContractRef("Event", t[1], d.symbol.path, "produces"))
    for m in re.finditer(r"\.route\s*\(", src.bare):
        inner, closed = _params(src, m.end() - 1)
        path = src.literal(m.end(), closed)
        for v in re.finditer(rf"\b(get|post|put|delete|patch|head|options)\s*\(\s*((?:{_IDENT}::)*{_IDENT})\s*\)", inner):
            if path is not None:
                out.contracts.append(ContractRef("ApiRoute", f"{v[1].upper()} {path}", v[2].rsplit("::", 1)[-1], "produces"))
    macros = config.get("database_macros", ["query", "query_as", "query_scalar"])
    for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, macros))})!?\s*\(", src.bare):
        owner = _owner(decls, m.start(), ("Function",))
        sql = src.literal(m.end(), _params(src, m.end() - 1)[1])
        if owner and sql:
            words = [w for w in re.split(r"\W+", sql) if w]
            for w, after in zip(words, words[1:], strict=False):
                role = {"FROM": "reads", "JOIN": "reads", "INTO": "writes", "UPDATE": "writes"}.get(w.upper())
                if role:
                    out.contracts.append(ContractRef("Table", after, owner.symbol.path, role))
    out.symbols = [d.symbol for d in decls]
    for path, line in sorted(events):
        short = path.rsplit("::", 1)[-1]
        out.symbols.append(Symbol("Contract", short, line, line, contract_kind="Event"))
    return out


# ---- TypeScript and JavaScript ----

_SCRIPT_DECL = re.compile(
    rf"(?P<export>\bexport\s+)?(?P<default>default\s+)?(?:async\s+)?\bfunction\b\s*\*?\s*(?P<fn>{_IDENT})?"
    rf"|(?P<cexport>\bexport\s+)?(?P<cdefault>default\s+)?(?:abstract\s+)?\bclass\s+(?P<cls>{_IDENT})"
    rf"|(?:\bexport\s+)?\b(?:const|let|var)\s+(?P<var>{_IDENT})\s*(?::[^=;\n]+)?=\s*(?P<arrow>(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=;]+)?=>|{_IDENT}\s*=>))?"
)
_METHOD = re.compile(rf"(?:^|[;}}\n])\s*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?\s*({_IDENT})\s*(?:<[^>(]*>)?\(")


def _specifier(spec: str, module: str, aliases: list | None) -> str | None:
    from ..sources.files import resolve_alias

    spec = re.sub(r"\.(?:tsx?|jsx?|mjs)$", "", spec)
    if spec.startswith("."):
        parts = module.split("::")[:-1] if module else []
        for p in spec.split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p != ".":
                parts.append(p)
        return "::".join(parts)
    found = resolve_alias(spec, aliases or [])
    return re.sub(r"^src/", "", found).replace("/", "::") if found is not None else spec.replace("/", "::")


#: Methods of a navigation object that take a route's name, and the prefix of a route's symbol.
NAVIGATE_METHODS = "navigate push popTo replace jumpTo".split()
ROUTE = "route:"
_NAVIGATES = re.compile(rf"(?<![\w$.])(?:navigate|((?:{_IDENT}\??\.)*{_IDENT})\??\.(?:{'|'.join(NAVIGATE_METHODS)}))\s*\(")


def _route_name(src: Source, pos: int) -> tuple[str | None, int]:
    """A route's name written at a place, as a string or as a member of a constant, and where it ends."""
    m = re.compile(rf"\s*(?:(\")|{_IDENT}(?:\.{_IDENT})*\.({_IDENT})(?!\s*[\w.(]))").match(src.bare, pos)
    if not m:
        return None, pos
    if m[2]:
        return m[2], m.end()
    i = bisect.bisect_left(src.at, m.start(1))
    text = src.literals[i][1] if i < len(src.at) and src.at[i] == m.start(1) else "``"
    name = None if text.startswith("`") else text[1:-1].replace("::", ":")
    return name or None, m.start(1) + len(text)


def _screens(src: Source) -> list[tuple[str, str, int, int]]:
    """(route, component, start, end) of screen elements and of the entries of a screens object."""
    found = []
    for m in re.finditer(rf"<(?:{_IDENT}\.)*Screen\b", src.bare):
        end, depth = m.end(), 0
        while end < len(src.bare) and (depth or src.bare[end] != ">"):
            depth += {"{": 1, "}": -1}.get(src.bare[end], 0)
            end += 1
        name = re.compile(r"\bname\s*=\s*\{?").search(src.bare, m.end(), end)
        shown = re.compile(rf"\bcomponent\s*=\s*\{{\s*({_IDENT})\s*\}}").search(src.bare, m.end(), end)
        route = _route_name(src, name.end())[0] if name else None
        if route and shown:
            found.append((route, shown[1], m.start(), end))
    for m in re.finditer(r"\bscreens\s*:\s*\{", src.bare):
        at, closed = m.end(), src.close(m.end() - 1)
        while at < closed:
            key = re.compile(rf"[\s,]*(?:({_IDENT})|(?=\"))").match(src.bare, at, closed)
            if not key:
                break
            route, after = (key[1], key.end()) if key[1] else _route_name(src, key.end())
            value = re.compile(rf"\s*:\s*(?:({_IDENT})\s*(?=[,}}]|$)|(\{{))?").match(src.bare, after)
            end, shown = after, None
            if value and value[2]:
                end = src.close(value.start(2))
                inner = re.compile(rf"[{{,]\s*screen\s*:\s*({_IDENT})\s*[,}}]").search(src.bare, value.start(2), end + 1)
                shown = inner[1] if inner else None
            elif value and value[1]:
                shown = value[1]
            if route and shown:
                found.append((route, shown, key.end() if not key[1] else key.start(1), end))
            comma = re.compile(r",").search(src.bare, max(end, value.end() if value else after), closed)
            at = comma.end() if comma else closed
    return found


def _routes(src: Source, out: Extract, decls: list[Decl], scope: Scope, module: str, test_file: bool) -> None:
    """A symbol for each route that a file registers, referring to its component; a reference by name for each navigation."""
    taken = set()
    for route, component, start, end in [] if test_file else _screens(src):
        path = join(module, f"{ROUTE}{route}")
        if path not in taken:
            taken.add(path)
            out.symbols.append(Symbol("Field", path, src.line(start), src.line(end)))
        tag, where = scope.bare(component)
        if tag != "Opaque":
            out.refs.append(Ref(path, scope.original(component), "References", tag, where))
    for m in _NAVIGATES.finditer(src.bare):
        if m[1] and "nav" not in m[1].lower():
            continue
        route, end = _route_name(src, m.end())
        if route and re.compile(r"\s*[,)]").match(src.bare, end):
            owner = _owner(decls, m.start())
            out.refs.append(Ref(owner.symbol.path if owner else join(module, MODULE), f"{ROUTE}{route}", "References"))


def script(file: str, module: str, text: str, config: dict | None = None) -> Extract:
    src, out, decls, scope = Source(text, True), Extract(), [], Scope(module)
    aliases = (config or {}).get("aliases")
    base = file.rsplit("/", 1)[-1]
    test_file = ".test." in base or ".spec." in base or "__tests__/" in file
    out.symbols.append(Symbol("Module", join(module, MODULE), 1, 1, is_test=test_file))
    for m in re.finditer(r"\b(import|export)\s+(type\s+)?([^;'\"()=]*?)\bfrom\s*\"", src.bare):
        spec = src.literal(m.end() - 1, m.end() + 1)
        if spec is None or m[2]:
            continue
        to, clause = _specifier(spec, module, aliases), m[3]
        out.refs.append(Ref(join(module, MODULE), MODULE, "Imports", "Module", to))
        named = re.search(r"\{([^}]*)\}", clause)
        items = [re.split(r"\s+as\s+", x.strip()) for x in named[1].split(",") if x.strip() and not x.strip().startswith("type ")] if named else []
        if m[1] == "import":
            plain = re.match(rf"\s*({_IDENT})", clause)
            if plain:
                scope.defaults[plain[1]] = to
            star = re.search(rf"\*\s+as\s+({_IDENT})", clause)
            if star:
                scope.imports[star[1]] = to
            for x in items:
                if x[0] == "default":
                    scope.defaults[x[-1]] = to
                else:
                    scope.imports[x[-1]] = to
                    if len(x) > 1:
                        scope.aliases[x[1]] = x[0]
        else:
            names = [x[0] if len(x) == 1 else f"{x[0]} as {x[1]}" for x in items] or (["*"] if "*" in clause else [])
            out.refs += [Ref(join(module, MODULE), n, "Imports", "Module", to) for n in names]
    for m in re.finditer(rf"\b(?:const|let|var)\s+(\{{[^}}]*\}}|{_IDENT})\s*=\s*require\s*\(", src.bare):
        spec = src.literal(m.end(), m.end() + 2)
        if spec is not None:
            to = _specifier(spec, module, aliases)
            out.refs.append(Ref(join(module, MODULE), MODULE, "Imports", "Module", to))
            for x in re.findall(rf"({_IDENT})\s*(?::\s*({_IDENT}))?", m[1]):
                scope.imports[x[1] or x[0]] = to
    default_name = next((m[1] for m in re.finditer(rf"\bexport\s+default\s+(?:\w+\s*\()*\s*({_IDENT})\s*[;)\n]", src.bare)), None)
    for m in _SCRIPT_DECL.finditer(src.bare):
        if m["cls"]:
            body, end = src.body_of(m.end())
            decls.append(Decl(Symbol("Type", join(module, m["cls"]), src.line(m.start()), src.line(end), is_test=test_file, is_default_export=bool(m["cdefault"]) or m["cls"] == default_name), m.start(), body, end))
            depth = src.bare[body + 1 : end]
            for x in _METHOD.finditer(depth):
                at = body + 1 + x.start(1)
                nest = src.bare[body + 1 : at]
                if x[1] in KEYWORDS - {"constructor"} or nest.count("{") != nest.count("}"):
                    continue
                _, closed = _params(src, at)
                b2, e2 = src.body_of(closed)
                if b2 != e2:
                    decls.append(Decl(Symbol("Function", join(module, m["cls"], x[1]), src.line(at), src.line(e2), is_test=test_file, owner=m["cls"]), at, b2, e2))
            scope.locals.add(m["cls"])
        elif m["fn"] or m["default"]:
            _, closed = _params(src, m.end())
            body, end = src.body_of(closed)
            name = m["fn"] or "default"
            decls.append(Decl(Symbol("Function", join(module, name), src.line(m.start()), src.line(end), is_test=test_file, is_default_export=bool(m["default"]) or name == default_name), m.start(), body, end))
            scope.locals.add(name)
        elif m["var"]:
            stop = re.compile(r"[;\n]").search(src.bare, m.end())
            stop_at = stop.start() if stop else len(src.bare)
            brace = src.bare.find("{", m.end())
            if m["arrow"] and 0 <= brace <= stop_at:
                stop_at = src.close(brace)
            value = src.bare[m.end() : stop_at]
            top = src.bare[: m.start()].count("{") == src.bare[: m.start()].count("}")
            if m["arrow"]:
                kind = "Function"
            elif _CALL.search(value) and "require" not in value or top and value.lstrip().startswith("{"):
                kind = "Field"
                opened = re.compile(r"[({\[]").search(src.bare, m.end())
                if opened:
                    stop_at = max(stop_at, src.close(opened.start(), {"(": "()", "{": "{}", "[": "[]"}[opened[0]]))
            else:
                continue
            decls.append(Decl(Symbol(kind, join(module, m["var"]), src.line(m.start()), src.line(stop_at), is_test=test_file, is_default_export=m["var"] == default_name), m.start(), m.end(), stop_at))
            if top:
                scope.locals.add(m["var"])

    def target(parts: list[str], owner: Decl | None) -> Ref | None:
        if parts[-1] in CALL_HELPERS or len(parts) > 1 and parts[0] in SCRIPT_GLOBALS and not scope.known(parts[0]):
            return None
        if len(parts) == 1:
            return None if parts[0] == "require" else Ref("", scope.original(parts[0]), "Calls", *scope.bare(parts[0]))
        if parts[0] == "this" and owner and owner.symbol.owner:
            return Ref("", f"{owner.symbol.owner}::{parts[-1]}", tag="Module", module=module)
        tag, where = scope.qualified(parts[0])
        if parts[0] in scope.defaults:
            return Ref("", parts[-1], tag="ModuleDefault", module=scope.defaults[parts[0]])
        return Ref("", parts[-1], "Calls", tag, where)

    _collect(src, out, decls, scope, module, True, target)
    for m in re.finditer(rf"<({_IDENT})\b|[(,\[]\s*({_IDENT})\s*(?=[,)\]])|=\{{\s*({_IDENT})\s*\}}", src.bare):
        name = m[1] or m[2] or m[3]
        if scope.known(name):
            owner = _owner(decls, m.start())
            out.refs.append(Ref(owner.symbol.path if owner else join(module, MODULE), scope.original(name), "References", *scope.bare(name)))
    for m in re.finditer(rf"\b({_IDENT})\.(get|post|put|delete|patch|head|options|all)\s*\(", src.bare):
        inner, closed = _params(src, m.end() - 1)
        path = src.literal(m.end(), closed)
        handler = re.search(rf",\s*({_IDENT}(?:\.{_IDENT})*)\s*$", inner)
        if path and path.startswith("/") and handler:
            out.contracts.append(ContractRef("ApiRoute", f"{m[2].upper()} {path}", handler[1].rsplit(".", 1)[-1], "produces"))
    out.symbols += [d.symbol for d in decls]
    _routes(src, out, decls, scope, module, test_file)
    return out


# ---- Go ----

_GO_FUNC = re.compile(rf"(?m)^func\s+(?:\(\s*(?:({_IDENT})\s+)?\*?\s*({_IDENT})[^)]*\)\s*)?({_IDENT})")


def go_types(text: str) -> list[str]:
    """Types of a parameter or result list, names dropped."""
    parts, depth, cur = [], 0, ""
    for c in text + ",":
        if c == "," and depth == 0:
            if cur.strip():
                parts.append(cur.strip())
            cur = ""
            continue
        depth += (c in "([{") - (c in ")]}")
        cur += c
    named = [re.match(rf"^({_IDENT})\s+(\S.*)$", p, re.S) for p in parts]
    if any(n and n[1] not in ("chan", "func", "map", "struct", "interface") for n in named):
        typed, last = [], ""
        for p, n in zip(reversed(parts), reversed(named), strict=True):
            last = n[2] if n else last
            typed.append(last)
        parts = typed[::-1]
    return [re.sub(rf"(?:{_IDENT})\.(?=[^.])", "", re.sub(r"\s", "", p)) for p in parts]


def _go_signature(src: Source, pos: int, end: int) -> str:
    inner, closed = _params(src, pos)
    rest = src.bare[closed + 1 : end].strip()
    results = rest[1:-1] if rest.startswith("(") and rest.endswith(")") else rest
    return f"({','.join(go_types(inner))})({','.join(go_types(results))})"


def go(file: str, module: str, text: str, config: dict | None = None) -> Extract:
    src, out, decls = Source(text), Extract(), []
    package = module.rsplit("::", 1)[0] if "::" in module else ""
    scope = Scope(module, ("Module", package))
    out.generated = re.search(r"(?m)^// Code generated .* DO NOT EDIT\.$", text) is not None
    for block in re.finditer(r"(?m)^import\s*(\([^)]*\)|[^\n]*)", text):
        for m in re.finditer(rf'(?:({_IDENT}|[._])\s+)?"([^"]+)"', block[1]):
            name = m[1] or m[2].rsplit("/", 1)[-1]
            if m[1] == ".":
                scope.wildcards.append(m[2].replace("/", "::"))
            elif m[1] != "_":
                scope.imports[name] = m[2].replace("/", "::")
    for m in _GO_FUNC.finditer(src.bare):
        _, closed = _params(src, m.end())
        body, end = src.body_of(closed)
        test = file.endswith("_test.go") and re.match(r"Test(?![a-z])", m[3]) is not None and not m[2]
        decls.append(Decl(Symbol("Function", join(module, m[2] or "", m[3]), src.line(m.start()), src.line(end), is_test=test, owner=m[2], signature=_go_signature(src, m.end(), body)), m.start(), body, end))
        if not m[2]:
            scope.locals.add(m[3])
    for m in re.finditer(rf"(?m)^type\s+(?:\(\s*)?({_IDENT})\s+(interface\b|struct\b)?", src.bare):
        body, end = src.body_of(m.end()) if m[2] else (m.end(), m.end())
        decls.append(Decl(Symbol("Type", join(module, m[1]), src.line(m.start()), src.line(end)), m.start(), body, end))
        scope.locals.add(m[1])
        if m[2] == "interface":
            lines = [x for x in src.bare[body + 1 : end].split("\n")]
            embedded = any(re.match(rf"^\s*(?:{_IDENT}\.)?{_IDENT}\s*$", x) for x in lines)
            at = body + 1
            for x in lines:
                spec = re.match(rf"^\s*({_IDENT})\s*\(", x)
                if spec:
                    line = src.line(at + spec.start(1))
                    sig = None if embedded else _go_signature(src, at + spec.end(1), at + len(x))
                    decls.append(Decl(Symbol("Function", join(module, m[1], spec[1]), line, line, is_abstract=True, owner=m[1], signature=sig), -1, -1, -2))
                at += len(x) + 1
    for m in re.finditer(rf"(?m)^(?:var|const)\s+({_IDENT})[^=\n]*=\s*([^\n]*)", src.bare):
        if _CALL.search(m[2]):
            decls.append(Decl(Symbol("Field", join(module, m[1]), src.line(m.start()), src.line(m.end())), m.start(), m.end(), m.end()))
            scope.locals.add(m[1])
    typed = {d.start: dict(re.findall(rf"({_IDENT})\s+\*?(?:{_IDENT}\.)?([^\W\d_a-z]\w*)", src.bare[d.start : d.body])) for d in decls if d.symbol.kind == "Function" and d.start >= 0}

    def target(parts: list[str], owner: Decl | None) -> Ref | None:
        if len(parts) == 1:
            return Ref("", parts[0], "Calls", *scope.bare(parts[0]))
        declared = typed.get(owner.start, {}).get(parts[0]) if owner else None
        if declared and len(parts) == 2:
            extra.append(Ref(owner.symbol.path, f"{declared}::{parts[1]}", "Calls", "Module", package))
        tag, where = scope.qualified(parts[0])
        return Ref("", parts[-1], "Calls", tag, where)

    extra: list[Ref] = []
    _collect(src, out, decls, scope, module, False, target)
    out.refs += extra
    # Types of imported packages, named in signatures, fields and literals.
    for m in re.finditer(rf"(?<![\w.])({_IDENT})\.([^\W\d_a-z]\w*)\b(?!\s*\()", src.bare):
        owner = _owner([d for d in decls if d.start >= 0], m.start(), ("Function", "Type")) if m[1] in scope.imports else None
        if owner:
            out.refs.append(Ref(owner.symbol.path, m[2], "References", "Module", scope.imports[m[1]]))
    for m in re.finditer(r"\.?\bHandleFunc\s*\(|\.Handle\s*\(", src.bare):
        inner, closed = _params(src, m.end() - 1)
        route = src.literal(m.end(), closed)
        handler = re.search(rf",\s*((?:{_IDENT}\.)*{_IDENT})\s*$", inner)
        verb = (route or "").split(" ", 1)
        if handler and len(verb) == 2 and verb[0] in GO_VERBS:
            out.contracts.append(ContractRef("ApiRoute", f"{verb[0]} {verb[1].strip()}", handler[1].rsplit(".", 1)[-1], "produces"))
    for m in re.finditer(r"\.(?:Exec|Query|QueryRow)(?:Context)?\s*\(", src.bare):
        owner = _owner(decls, m.start(), ("Function",))
        sql = src.literal(m.end(), _params(src, m.end() - 1)[1])
        if owner and sql:
            out.contracts += [ContractRef("Table", t, owner.symbol.path, role) for t, role in quoted_rule_tables(unescape_go(sql))]
    out.symbols = [d.symbol for d in decls]
    return out


# ---- Kotlin, Swift, C++ ----

_PLAIN = {
    "kotlin": re.compile(rf"\b(?:(?P<fn>fun)\s+(?:<[^>]*>\s*)?(?:{_IDENT}\.)?(?P<name>{_IDENT})|(?P<cls>class|object|interface)\s+(?P<cname>{_IDENT})|(?P<val>val|var)\s+(?P<vname>{_IDENT})[^=\n]*=)"),
    "swift": re.compile(rf"\b(?:(?P<fn>func)\s+(?P<name>{_IDENT})|(?P<cls>class|struct|enum|actor|extension)\s+(?P<cname>{_IDENT})|(?P<val>let|var)\s+(?P<vname>{_IDENT})[^=\n]*=)"),
    "cpp": re.compile(rf"\b(?P<cls>class|struct|namespace)\s+(?P<cname>{_IDENT}(?:::{_IDENT})*)(?=[^;()=]*\{{)|(?P<fn>)(?<![\w.>])(?P<name>~?{_IDENT}(?:::~?{_IDENT})*)\s*\((?=[^;{{}}]*\)[^;{{}}()]*(?::[^;{{}}]*)?\{{)(?P<val>)(?P<vname>)"),
}


def plain(language: str, file: str, module: str, text: str) -> Extract:
    src, out, decls = Source(text), Extract(), []
    package = module.rsplit("::", 1)[0] if "::" in module else ""
    scope = Scope(module, ("Module", package) if language == "kotlin" else ("Unscoped", ""))
    if language == "kotlin":
        for m in re.finditer(rf"(?m)^\s*import\s+([\w.]+)(\.\*)?(?:\s+as\s+({_IDENT}))?", src.bare):
            path = m[1].split(".")
            if m[2]:
                scope.wildcards.append("::".join(path))
            else:
                scope.imports[m[3] or path[-1]] = "::".join(path[:-1])
    spans: list[tuple[int, int, str, bool]] = []
    for m in _PLAIN[language].finditer(src.bare):
        around = [s for s in spans if s[0] <= m.start() <= s[1]]
        prefix = join(module, *[s[2] for s in around])
        if m["cls"]:
            body, end = src.body_of(m.end())
            suite = "XCTestCase" in src.bare[m.end() : body]
            spans.append((m.start(), end, m["cname"], suite))
            if m["cls"] not in ("namespace", "extension"):
                decls.append(Decl(Symbol("Type", join(prefix, m["cname"]), src.line(m.start()), src.line(end)), m.start(), body, end))
                scope.locals.add(m["cname"])
        elif m["name"]:
            if m["name"] in KEYWORDS:
                continue
            _, closed = _params(src, m.end("name"))
            line_end = src.bare.find("\n", closed)
            if language == "kotlin" and "=" in src.bare[closed:line_end] and "{" not in src.bare[closed:line_end]:
                body, end = closed, line_end if line_end >= 0 else len(src.bare)
            else:
                body, end = src.body_of(closed)
            if _owner(decls, m.start(), ("Function",)) and language != "cpp":
                continue
            before = src.bare[max(src.bare.rfind("}", 0, m.start()), src.bare.rfind("{", 0, m.start()), 0) : m.start()]
            test = language == "kotlin" and re.search(r"@(?:\w+\.)*Test\b", before) is not None or language == "swift" and m["name"].startswith("test") and bool(around) and around[-1][3]
            owner = around[-1][2] if around else None
            decls.append(Decl(Symbol("Function", join(prefix, m["name"]), src.line(m.start()), src.line(end), is_test=test, owner=owner), m.start(), body, end))
            scope.locals.add(m["name"])
        elif m["vname"] and not _owner(decls, m.start(), ("Function",)):
            stop = src.bare.find("\n", m.end())
            if _CALL.search(src.bare[m.end() : stop if stop >= 0 else None]):
                decls.append(Decl(Symbol("Field", join(prefix, m["vname"]), src.line(m.start()), src.line(stop)), m.start(), m.end(), stop if stop >= 0 else len(src.bare)))

    def target(parts: list[str], owner: Decl | None) -> Ref | None:
        if len(parts) == 1:
            return Ref("", parts[0], "Calls", *scope.bare(parts[0]))
        if parts[0] in ("this", "self") and owner and owner.symbol.owner:
            return Ref("", f"{owner.symbol.owner}::{parts[-1]}", tag="Module", module=module)
        tag, where = scope.qualified(parts[0])
        if language == "cpp":
            return Ref("", "::".join(parts[-2:]) if parts[0][:1].isupper() else parts[-1], tag="Unscoped")
        return Ref("", f"{parts[0]}::{parts[-1]}" if tag == "Module" and parts[0][:1].isupper() else parts[-1], "Calls", tag, where)

    _collect(src, out, decls, scope, module, False, target)
    out.symbols = [d.symbol for d in decls]
    return out


def cpp(file: str, module: str, text: str, config: dict | None = None) -> Extract:
    """C++ with conditional sections blanked where they leave braces unbalanced."""
    if text.count("{") != text.count("}"):
        flat = re.sub(r"(?m)^[ \t]*#.*$", lambda m: " " * len(m[0]), re.sub(r"(?ms)^[ \t]*#\s*if.*?^[ \t]*#\s*endif[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), text))
        if abs(flat.count("{") - flat.count("}")) < abs(text.count("{") - text.count("}")):
            text = flat
    return plain("cpp", file, module, text)

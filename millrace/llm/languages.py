"""Lexers and grammars of the languages whose files are checked: Cryptol, SAWScript, Python and JSON.

A lexer turns a text into a string of token kinds, with layout made explicit by tokens of its own, and the recogniser reads the whole string;
brackets, blocks and statements are rules of the grammars. Files repeat statements and brackets of the same kinds very often, so
the recogniser keeps where these can end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from millrace.llm.gll import Grammar, Kinds, brackets

# --- Cryptol ----------------------------------------------------------------------------------------------

_CRY = Kinds()
#: The reserved words.
CRYPTOL_WORDS = (
    "as by case constraint down else enum extern foreign hiding if import include infix infixl infixr interface let module newtype of parameter pragma "
    "primitive private Prop property submodule then type where"
).split()
#: Operators with a meaning of their own.
CRYPTOL_MARKS = "= : -> <- => .. ... ..< ..> | \\ ` <| |> - * ~ . ( ) [ ] { } , ; v{ v} v; _ # @ ! ^^ :: ( < +".split()

CRYPTOL = Grammar(
    r"""
file: ('v{' (topdecl ('v;' topdecl)*)? 'v}')?
    | 'module' modname 'where' 'v{' (topdecl ('v;' topdecl)*)? 'v}'
    | 'interface' 'module' modname 'where' 'v{' (param ('v;' param)*)? 'v}'
    | 'module' modname '=' modname ('{' modargs '}' | 'where' vdecls?)
    | 'interface' 'module' modname '=' modname '{' modargs '}'
fragment: expr | decl ('v;' decl)*
modargs: modarg (',' modarg)*
modarg: modname | 'interface' modname | '_' | modname '=' (modname | 'interface' modname | '_') | 'submodule' modname
modname: 'submodule'? NAME
topdecl: decl
    | import
    | 'include' STRING
    | 'property' NAME apat* '=' expr
    | 'newtype' NAME tparam* (':' kind)? '=' NAME? '{' fields? '}'
    | <3.3> 'enum' NAME tparam* '=' '|'? con ('|' con)*
    | 'primitive' 'type' type ':' kind
    | 'primitive' 'type' '{' tparams '}' type '=>' type ':' kind
    | 'primitive' (NAME | '(' OPERATORS ')') ':' schema
    | 'foreign' NAME ':' schema
    | 'private' vtopdecls
    | 'parameter' vparams
    | 'submodule' NAME 'where' vtopdecls
    | 'submodule' NAME '=' modname ('{' modargs '}' | 'where' vdecls)
    | 'interface' 'submodule' NAME 'where' vparams
    | 'interface' 'constraint' type
vtopdecls: 'v{' topdecl ('v;' topdecl)* 'v}'
vparams: 'v{' param ('v;' param)* 'v}'
param: 'type' NAME ':' kind | 'type' 'constraint' type | names ':' schema | decl | 'import' 'interface' modname ('as' NAME)?
con: NAME atype* | NAME '{' fields? '}'
import: 'import' ('interface' | 'submodule')? NAME ('{' modargs '}')? ('as' NAME)? importlist? ('where' vdecls)?
importlist: 'hiding'? '(' (importname (',' importname)*)? ')'
importname: 'type'? NAME | '(' OPERATORS ')'
vdecls: 'v{' (decl ('v;' decl)*)? 'v}' | '{' (decl (';' decl)* ';'?)? '}'
decl: names ':' schema
    | NAME apat* indices? rhs
    | '(' OPERATORS ')' apat* rhs
    | apat OPERATORS apat rhs
    | pattern '=' expr
    | ('infixl' | 'infixr' | 'infix') NUMBER OPERATORS (',' OPERATORS)*
    | 'type' ('constraint')? NAME tparam* '=' type
    | 'type' ('constraint')? tparam OPERATORS tparam '=' type
    | 'type' ('infixl' | 'infixr' | 'infix') NUMBER OPERATORS (',' OPERATORS)*
rhs: '=' expr | guard+
guard: '|' type '=>' expr
indices: '@' apat+ | '!' apat+
names: name (',' name)*
name: NAME | '(' OPERATORS ')'
kind: kindpart ('->' kindpart)*
kindpart: '#' | '*' | 'Prop' | '(' kind ')'
tparam: NAME | '(' NAME (':' kind)? ')' | '_'
tparams: onetparam (',' onetparam)*
onetparam: NAME (':' kind)?
schema: ('{' tparams? '}')? (type '=>')* type
type: typeinfix ('->' type)?
typeinfix: apptype (TYPEOPS apptype)*
apptype: NAME atype* | dims atype? | tatom
dims: dim+
dim: '[' type ']'
atype: NAME | tatom | dims atype?
tatom: NUMBER | CHAR | '_' | '(' ')' | '(' type (',' type)* ')' | '(' TYPEOPS ')' | '{' fields? '}'
fields: field (',' field)*
field: NAME ':' type
pattern: apat (':' type)? | apat '#' apat ('#' apat)* | NAME apat+
apat: NAME | '_' | '(' ')' | '(' pattern (',' pattern)* ')' | '[' ']' | '[' pattern (',' pattern)* ']' | '{' (fieldpat (',' fieldpat)*)? '}'
fieldpat: NAME '=' pattern
expr: core ('where' vdecls)*
core: infix (':' type)?
infix: last | unary (OPERATORS unary)* (OPERATORS last)?
unary: ('-' | '~') unary | apply
last: ('-' | '~')* (lambda | conditional | cases)
lambda: '\' apat+ '->' core
conditional: 'if' core 'then' core ('|' core 'then' core)* 'else' core
cases: <3.3> 'case' core 'of' 'v{' alternative ('v;' alternative)* 'v}'
alternative: pattern '->' expr
apply: atom+
atom: base SELECTOR*
base: NAME | NUMBER | STRING | CHAR | '_' | group | '`' tick | '<|' poly '|>'
group: '(' ')' | '(' expr (',' expr)* ')' | '(' OPERATORS ')' | '(' infix OPERATORS ')'
    | '[' ']' | '[' list ']' | '{' '}' | '{' (fieldval (',' fieldval)*) '}' | '{' expr '|' update (',' update)* '}'
tick: NAME | NUMBER | '(' type ')' | '{' tickarg (',' tickarg)* '}' | '_'
tickarg: type | NAME '=' type
fieldval: fieldpath apat* ('=' expr)
fieldpath: NAME SELECTOR* | NUMBER
update: fieldpath apat* ('=' | '->') expr
list: expr (',' expr)*
    | expr ('|' arm)+
    | expr (',' expr)? '..' ('<' | '>')? expr ('down'? 'by' expr)?
    | expr ('..<' | '..>') expr ('down'? 'by' expr)?
    | expr (',' expr)? '...'
    | expr '..' 'down' 'by' expr
arm: match (',' match)*
match: pattern '<-' expr | 'let' decl | NAME apat* '=' expr
poly: term ('+' term)*
term: NUMBER | NAME ('^^' NUMBER)? | '(' expr ')'
""",
    ("3.0", "3.3"),
    _CRY,
    {"OPERATORS": ("OP", "-", "*", "#", "@", "!", "^^", "<", "+"), "TYPEOPS": ("OP", "-", "*", "#", "@", "!", "^^", "<", "+")},
    {"group": 0, "dim": 0, "topdecl": 1, "decl": 1, "param": 1, "alternative": 1},
)

_CRY_KIND = {w: _CRY[w] for w in CRYPTOL_WORDS} | {"_": _CRY["_"]}
_CRY_OP = {w: _CRY[w] for w in CRYPTOL_MARKS if w not in ("v{", "v}", "v;", "_")}
_C_NAME, _C_NUMBER, _C_STRING, _C_CHAR, _C_SELECTOR, _C_OP = (_CRY[x] for x in ("NAME", "NUMBER", "STRING", "CHAR", "SELECTOR", "OP"))
_C_BAD, _C_OPEN, _C_SEMI, _C_CLOSE = _CRY["bad"], _CRY["v{"], _CRY["v;"], _CRY["v}"]
_C_LAYOUT = {_CRY["where"], _CRY["private"], _CRY["parameter"], _CRY["of"]}
_ESCAPE = r"\\(?:[abfnrtv\\\"'&]|\d+|x[0-9A-Fa-f]+|o[0-7]+|\^[@-_]|[A-Z]{2,3}\d?)"
_CRY_TOKEN = re.compile(
    rf"""[ \t\f\v\xa0]*+(?:(\r\n|\r|\n)
    |(//[^\r\n]*)|(/\*)
    |([^\W\d][\w']*(?:::[^\W\d][\w']*)*(?:::[!#$%&*+\-./:<=>?@\\^|~]+)?)
    |([()\[\]{{}},;`])
    |(0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]+)?(?:[pP][+-]?\d+)?|0[bB][01_]+(?:\.[01_]+)?|0[oO][0-7_]+(?:\.[0-7_]+)?|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)(?![\w'])
    |(\.(?:[^\W\d][\w']*|\d+))
    |([!#$%&*+\-./:<=>?@\\^|~]+|[^\x00-\x7f\w])
    |("(?:[^"\\\r\n]|{_ESCAPE})*")
    |('(?:[^'\\\r\n]|{_ESCAPE})')
    |(\Z)|(.))""",
    re.X,
)
_COMMENT = re.compile(r"/\*|\*/")
def _comment_end(text: str, at: int) -> int:
    """Behind a nested comment that begins at `at`, or -1."""
    depth = 0
    for m in _COMMENT.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return -1


def _symbol(c: str) -> bool:
    return unicodedata.category(c) in ("Sm", "Sc", "Sk", "So")


def cryptol_tokens(text: str, at: int = 0, end: int | None = None) -> Iterator[tuple[str, int]]:
    """(kind, column or -1 if not the first of its line) of each token."""
    end = len(text) if end is None else end
    line, first = at, True
    scan = _CRY_TOKEN.scanner(text, at, end)
    kinds, ops = _CRY_KIND, _CRY_OP
    while m := scan.match():
        k = m.lastindex
        if k == 1:
            line, first = m.end(), True
            continue
        if k == 2:
            continue
        if k == 3:
            behind = _comment_end(text, m.start(3))
            if behind < 0 or behind > end:
                yield _C_BAD, 0
                return
            cut = max(text.rfind("\n", m.start(3), behind), text.rfind("\r", m.start(3), behind))
            if cut >= 0:
                line, first = cut + 1, True
            scan = _CRY_TOKEN.scanner(text, behind, end)
            continue
        if k == 4:
            kind = kinds.get(m[4], _C_NAME)
        elif k == 5:
            kind = ops[m[5]]
        elif k == 6:
            kind = _C_NUMBER
        elif k == 7:
            before = m.start(7) - 1
            if m.start() == m.start(7) and before >= 0 and (text[before].isalnum() or text[before] in ")]}_'\""):
                kind = _C_SELECTOR
            else:
                kind = _C_BAD
        elif k == 8:
            x = m[8]
            kind = ops.get(x) or (_C_OP if x[0] < "\x80" or _symbol(x) else _C_BAD)
        elif k == 9:
            kind = _C_STRING
        elif k == 10:
            kind = _C_CHAR
        elif k == 11:
            return
        else:
            yield _C_BAD, 0
            return
        yield kind, (m.start(k) - line if first else -m.start(k) + line - 1)
        first = False


_CRY_EXPLICIT = {_CRY[a]: _CRY[b] for a, b in ("()", "[]", "{}")}
_CRY_CLOSERS = set(_CRY_EXPLICIT.values())


def cryptol_kinds(text: str, at: int = 0, end: int | None = None, top: bool = True) -> str | None:
    """A file as kinds, with the blocks that columns make; with `top` false an expression or declarations. None for bad tokens."""
    out: list[str] = []
    stack: list[int] = []  # columns of implicit blocks, -1 for brackets
    pending = started = False
    wait = False  # the block of a module opens behind its where
    for kind, place in cryptol_tokens(text, at, end):
        if kind == _C_BAD:
            return None
        first = place >= 0
        column = place if first else -place - 1
        if not started:
            started = True
            wait = top and kind in (_CRY["module"], _CRY["interface"])
            if top and not wait:
                out.append(_C_OPEN)
                stack.append(column)
                first = False
        if pending:
            pending = False
            outer = -1 if not stack or stack[-1] == -1 else next((c for c in reversed(stack) if c >= 0), -1)
            if kind == _CRY["{"] and stack:
                pass
            elif column > outer or (wait and not stack):
                out.append(_C_OPEN)
                stack.append(column)
                first = False
            else:
                out += (_C_OPEN, _C_CLOSE)
        if first and stack:
            while stack and stack[-1] > column:
                stack.pop()
                out.append(_C_CLOSE)
            if stack and stack[-1] == column:
                out.append(_C_SEMI)
        if kind in _CRY_EXPLICIT:
            stack.append(-1)
        elif kind in _CRY_CLOSERS or kind == _CRY[","]:
            if -1 in stack:
                while stack[-1] >= 0:
                    stack.pop()
                    out.append(_C_CLOSE)
                if kind != _CRY[","]:
                    stack.pop()
        out.append(kind)
        pending = kind in _C_LAYOUT
    if pending:
        out += (_C_OPEN, _C_CLOSE)
    out += [_C_CLOSE for c in stack if c >= 0]
    return "".join(out)


_CRY_PAIRS = _CRY_EXPLICIT | {_C_OPEN: _C_CLOSE}


def _cryptol_extents(kinds: str) -> tuple[list[int], list[int]]:
    """Of brackets, and of the entries of blocks from one layout mark to the next of the same block."""
    pairs = brackets(kinds, _CRY_PAIRS)
    entries = [0] * (len(kinds) + 1)
    stack: list[int] = []
    for k, c in enumerate(kinds):
        if c in _CRY_PAIRS:
            stack.append(k + 1 if c == _C_OPEN else -1)
        elif c in _CRY_CLOSERS or c == _C_CLOSE or c == _C_SEMI:
            if not stack:
                break
            if stack[-1] >= 0 and (c == _C_CLOSE or c == _C_SEMI):
                entries[stack[-1]] = k
            if c == _C_SEMI:
                if stack[-1] >= 0:
                    stack[-1] = k + 1
            else:
                stack.pop()
    return pairs, entries


def cryptol(text: str) -> frozenset[str]:
    """The dialects under which a text is a file: a module, an instance of one, or declarations without a header."""
    kinds = cryptol_kinds(text)
    return frozenset() if kinds is None else CRYPTOL.accepts("file", kinds, *_cryptol_extents(kinds))


def cryptol_fragment(text: str, at: int, end: int) -> bool:
    """Whether a piece of a text is an expression or declarations (as in a script's quotes)."""
    kinds = cryptol_kinds(text, at, end, top=False)
    return bool(kinds) and bool(CRYPTOL.accepts("fragment", kinds, *_cryptol_extents(kinds)))


# --- SAWScript --------------------------------------------------------------------------------------------

_SAW = Kinds()
SAW_WORDS = "import and let rec in do if then else as hiding typedef include".split()
SAWSCRIPT = Grammar(
    r"""
file: (stmt ';')*
stmt: <1.3> 'include' STRING
    | <1.0> 'include' expr
    | expr
    | pattern '<-' expr
    | 'let' definition ('and' definition)*
    | 'rec' definition ('and' definition)*
    | 'let' CODE
    | 'import' (STRING | NAME) ('as' NAME)? ('hiding'? '(' (NAME (',' NAME)*)? ')')?
    | 'typedef' NAME '=' type
definition: argument+ (':' type)? '=' expr
argument: NAME | '(' ')' | '(' pattern (',' pattern)* ')'
pattern: argument (':' type)?
expr: apply (':' type)?
    | '\' argument+ '->' expr
    | 'let' definition ('and' definition)* 'in' expr
    | 'rec' definition ('and' definition)* 'in' expr
    | 'if' expr 'then' expr 'else' expr
apply: atom+
atom: base ('.' (NAME | NUMBER))*
base: STRING | CODE | CTYPE | NUMBER | NAME | group | 'do' block
group: '(' ')' | '[' ']' | '(' expr (',' expr)* ')' | '[' expr (',' expr)* ']' | '{' (field (',' field)*)? '}'
block: '{' (stmt ';')* '}'
field: NAME '=' expr
type: typeapp ('->' type)?
typeapp: typeatom+
typeatom: NAME | '(' ')' | '(' type (',' type)* ')' | '[' type ']' | '{' (fieldtype (',' fieldtype)*)? '}' | '{' NAME (',' NAME)* '}' typeatom
fieldtype: NAME ':' type
""",
    ("1.0", "1.3"),
    _SAW,
    kept={"group": 0, "block": 0, "stmt": 1},
)
_SAW_KIND = {w: _SAW[w] for w in SAW_WORDS}
_SAW_OP = {w: _SAW[w] for w in ("<-", "->", "=", ";", ":", "\\", ".", ",", "(", ")", "[", "]", "{", "}")}
_S_NAME, _S_NUMBER, _S_STRING, _S_CODE, _S_CTYPE = (_SAW[x] for x in ("NAME", "NUMBER", "STRING", "CODE", "CTYPE"))
_SAW_TOKEN = re.compile(
    rf"""\s*+(?:(//[^\r\n]*)|(/\*)|(\{{\{{)|(\{{\|)
    |([^\W\d][\w']*(?:::[^\W\d][\w']*)*)
    |("(?:[^"\\\r\n]|{_ESCAPE})*")
    |(<-|->|[=;:\\.,()\[\]{{}}])(?![=<>&|^+*/%!~@\#-]|(?<=[=:])(?<=[=:])[=:])
    |(0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|\d+)(?![\w'])
    |(\Z)|(.))""",
    re.X | re.S,
)
_CODE_MARK = re.compile(r"\{\{|\}\}")
_SAW_PAIRS = {_SAW[a]: _SAW[b] for a, b in ("()", "[]", "{}")}
_SAW_CLOSERS = set(_SAW_PAIRS.values())
_S_SEMI, _S_BREAK = _SAW[";"], _SAW["break"]
#: Kinds that can begin a statement, and those behind which a statement goes on, whatever the next line begins with.
_S_BEGINS = {_S_NAME, *(_SAW[w] for w in ("import", "let", "rec", "include", "typedef"))}
_S_GOES_ON = {_SAW[w] for w in ("=", "<-", "->", ":", "\\", ",", ".", "and", "in", "then", "else", "if", "do", "let", "rec", "as", "hiding", "import", "include", "typedef")}


def saw_kinds(text: str) -> str | None:
    """A script as kinds; None for bad tokens or code. A name in a line's first column where the statement at hand began begins the next
    statement, so that a mark that no rule takes stands before it where no semicolon does."""
    out: list[str] = []
    begun: list[int] = [-1]  # column of the statement at hand in each open block, -1 before its first token
    opened: list[str] = []
    line, first = 0, True
    scan = _SAW_TOKEN.scanner(text)
    while m := scan.match():
        k = m.lastindex
        if k == 9:
            break
        start = m.start(k)
        gap = text.rfind("\n", m.start(), start)
        if gap >= 0:
            line, first = gap + 1, True
        if k == 1:
            continue
        if k == 2:
            behind = _comment_end(text, start)
            if behind < 0:
                return None
            gap = text.rfind("\n", start, behind)
            if gap >= 0:
                line, first = gap + 1, True
            scan = _SAW_TOKEN.scanner(text, behind)
            continue
        if k == 3:
            at, level, behind = m.end(), 1, -1
            for x in _CODE_MARK.finditer(text, at):
                level += 1 if x[0] == "{{" else -1
                if not level:
                    behind = x.start()
                    break
            if behind < 0 or not cryptol_fragment(text, at, behind):
                return None
            kind = _S_CODE
            scan = _SAW_TOKEN.scanner(text, behind + 2)
        elif k == 4:
            behind = text.find("|}", m.end())
            if behind < 0:
                return None
            kind = _S_CTYPE
            scan = _SAW_TOKEN.scanner(text, behind + 2)
        elif k == 5:
            kind = _SAW_KIND.get(m[5], _S_NAME)
        elif k == 6:
            kind = _S_STRING
        elif k == 7:
            kind = _SAW_OP[m[7]]
        elif k == 8:
            kind = _S_NUMBER
        else:
            return None
        if begun[-1] < 0:
            begun[-1] = start - line
        elif first and start - line <= begun[-1] and kind in _S_BEGINS and out[-1] not in _S_GOES_ON and (not opened or opened[-1] == "do"):
            out.append(_S_BREAK)
        if kind in _SAW_PAIRS:
            opened.append("do" if out and out[-1] == _SAW["do"] else "")
            begun.append(-1)
        elif kind in _SAW_CLOSERS and opened:
            opened.pop()
            begun.pop()
        elif kind == _S_SEMI:
            begun[-1] = -1
        out.append(kind)
        first = False
        if k in (3, 4):
            gap = text.rfind("\n", start, behind)
            line = gap + 1 if gap >= 0 else line
    return "".join(out)


def sawscript(text: str) -> frozenset[str]:
    kinds = saw_kinds(text)
    if kinds is None:
        return frozenset()
    statements = [0] * (len(kinds) + 1)
    stack = [0]
    for k, c in enumerate(kinds):
        if c in _SAW_PAIRS:
            stack.append(k + 1)
        elif c in _SAW_CLOSERS:
            if len(stack) == 1:
                break
            stack.pop()
        elif c == _S_SEMI:
            statements[stack[-1]] = k
            stack[-1] = k + 1
    return SAWSCRIPT.accepts("file", kinds, brackets(kinds, _SAW_PAIRS), statements)


# --- JSON -------------------------------------------------------------------------------------------------

_JSON = Kinds()
JSON = Grammar(
    """
file: value
value: VALUE | STRING | group
group: '[' ']' | '[' value (',' value)* ']' | '{' '}' | '{' STRING ':' value (',' STRING ':' value)* '}'
""",
    ("8259",),
    _JSON,
    kept={"group": 0},
)
_J_VALUE, _J_STRING = _JSON["VALUE"], _JSON["STRING"]
_JSON_OP = {c: _JSON[c] for c in "[]{},:"}
_JSON_TOKEN = re.compile(
    r"""[ \t\r\n]*+(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|([\[\]{},:])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)\b)|(\Z)|(.))""", re.S | re.A
)
_JSON_PAIRS = {_JSON[a]: _JSON[b] for a, b in ("[]", "{}")}


def json_value(text: str) -> frozenset[str]:
    out: list[str] = []
    for m in _JSON_TOKEN.finditer(text):
        k = m.lastindex
        if k == 1:
            out.append(_J_STRING)
        elif k == 2:
            out.append(_JSON_OP[m[2]])
        elif k == 3:
            out.append(_J_VALUE)
        elif k == 5:
            return frozenset()
        else:
            break
    kinds = "".join(out)
    return JSON.accepts("file", kinds, brackets(kinds, _JSON_PAIRS))


# --- Python -----------------------------------------------------------------------------------------------

_PY = Kinds()
PYTHON_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
PYTHON_SOFT = ("match", "case", "type", "_")
PYTHON_AUGMENTED = "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()
PYTHON_MARKS = "( ) [ ] { } , : ; . = -> := ... @ + - * / // % ** << >> & | ^ ~ < > <= >= == != ! NL IN OUT".split()
PYTHON = Grammar(
    r"""
file: statement*
field: (starred | yielding) '='? ('!' ID)?
casesline: 'case' patterns ('if' named)? ':' suite
statement: simple (';' simple)* ';'? 'NL' | compound
simple: starred | (targets '=')+ (starred | yielding) | single AUGMENTED (starred | yielding) | single ':' expr ('=' (starred | yielding))?
    | 'pass' | 'break' | 'continue' | 'return' starred? | 'raise' (expr ('from' expr)?)? | ('global' | 'nonlocal') ID (',' ID)*
    | 'del' deltargets | 'assert' expr (',' expr)? | yielding | 'import' dottedas (',' dottedas)*
    | 'from' ('.' | '...')* dotted 'import' imported | 'from' ('.' | '...')+ 'import' imported
    | <3.13> 'type' ID typeparams? '=' expr
imported: '*' | '(' nameas (',' nameas)* ','? ')' | nameas (',' nameas)*
nameas: ID ('as' ID)?
dotted: ID ('.' ID)*
dottedas: dotted ('as' ID)?
yielding: 'yield' ('from' expr | starred?)
compound: ('@' named 'NL')* ('async'? function | class) | if | while | 'async'? (for | with) | try | <3.13> 'match' subject ':' 'NL' 'IN' casesline+ 'OUT'
suite: 'NL' 'IN' statement+ 'OUT' | simple (';' simple)* ';'? 'NL'
if: 'if' named ':' suite ('elif' named ':' suite)* else?
else: 'else' ':' suite
while: 'while' named ':' suite else?
for: 'for' targets 'in' starred ':' suite else?
with: 'with' withitem (',' withitem)* ':' suite | <3.13> 'with' '(' withitem (',' withitem)* ','? ')' ':' suite
withitem: expr ('as' target)?
try: 'try' ':' suite (except+ else? finally? | finally)
except: 'except' (expr ('as' ID)?)? ':' suite | <3.13> 'except' '*' expr ('as' ID)? ':' suite
finally: 'finally' ':' suite
function: 'def' ID typeparams? '(' params? ')' ('->' expr)? ':' suite
class: 'class' ID typeparams? ('(' args? ')')? ':' suite
typeparams: <3.13> '[' typeparam (',' typeparam)* ','? ']'
typeparam: ID (':' expr)? ('=' expr)? | '*' ID ('=' expr)? | '**' ID ('=' expr)?
params: (positional (',' keywords)? | keywords) ','?
positional: plain (',' plain)* (',' '/' (',' plain)*)? (',' preset (',' preset)*)? | plain (',' plain)* (',' preset (',' preset)*) ',' '/' (',' preset)* | preset (',' preset)* (',' '/' (',' preset)*)?
keywords: '*' rest (',' (plain | preset))* (',' '**' plain)? | '*' (',' (plain | preset))+ (',' '**' plain)? | '**' plain
rest: plain | <3.13> ID ':' '*' binary
plain: ID (':' expr)?
preset: plain '=' expr
lparams: (lpositional (',' lkeywords)? | lkeywords) ','?
lpositional: ID (',' ID)* (',' '/' (',' ID)*)? (',' lpreset (',' lpreset)*)? | ID (',' ID)* (',' lpreset (',' lpreset)*) ',' '/' (',' lpreset)* | lpreset (',' lpreset)* (',' '/' (',' lpreset)*)?
lkeywords: '*' ID (',' (ID | lpreset))* (',' '**' ID)? | '*' (',' (ID | lpreset))+ (',' '**' ID)? | '**' ID
lpreset: ID '=' expr
targets: star (',' star)* ','?
star: '*'? target
target: ID | member | '(' targets? ')' | '[' targets? ']'
single: ID | member | '(' single ')'
deltargets: deltarget (',' deltarget)* ','?
deltarget: ID | member | '(' deltargets? ')' | '[' deltargets? ']'
member: head trailer* ('.' ID | index)
starred: starexpr (',' starexpr)* ','?
starexpr: '*' binary | expr
starnamed: '*' binary | named
namedlist: starnamed (',' starnamed)* ','?
named: ID ':=' expr | expr
expr: disjunction ('if' disjunction 'else' expr)? | 'lambda' lparams? ':' expr
disjunction: conjunction ('or' conjunction)*
conjunction: negation ('and' negation)*
negation: 'not' negation | binary (compare binary)*
compare: COMPARE | 'in' | 'not' 'in' | 'is' 'not'?
binary: unary (BINARY unary)*
unary: ('+' | '-' | '~')* 'await'? primary ('**' unary)?
primary: head trailer*
head: ID | NUMBER | strings | CONSTANT | '...' | group
group: '(' ')' | '(' yielding ')' | '(' named ')' | '(' starnamed ',' namedlist? ')' | '(' named comp+ ')'
    | '[' ']' | '[' namedlist ']' | '[' named comp+ ']' | '{' '}' | '{' namedlist '}' | '{' named comp+ '}' | '{' pair (',' pair)* ','? '}' | '{' expr ':' expr comp+ '}'
strings: (STRING | FSTRING)+ | BYTES+
plainstrings: STRING+ | BYTES+
pair: expr ':' expr | '**' binary
trailer: '.' ID | call | index
call: '(' args? ')'
index: '[' slices ']'
slices: slice (',' slice)* ','?
slice: named | expr? ':' expr? (':' expr?)? | <3.13> '*' binary
comp: 'async'? 'for' targets 'in' disjunction ('if' condition)*
condition: disjunction | 'lambda' lparams? ':' condition
args: parg (',' parg)* (',' karg)* (',' dargs)? ','? | karg (',' karg)* (',' dargs)? ','? | dargs ','? | named comp+
parg: '*' expr | named
karg: ID '=' expr | '*' expr
dargs: '**' expr (',' (ID '=' expr | '**' expr))*
subject: named | starnamed ',' namedlist?
patterns: openpattern (',' openpattern)* ','?
openpattern: '*' ID | aspattern
aspattern: orpattern ('as' ID)?
orpattern: closed ('|' closed)*
closed: '-'? NUMBER (('+' | '-') NUMBER)? | plainstrings | CONSTANT | ID | ID ('.' ID)+ | '(' patterns? ')' | '[' patterns? ']' | '{' (mappair (',' mappair)* ','?)? '}' | ID ('.' ID)* '(' (classarg (',' classarg)* ','?)? ')'
mappair: (plainstrings | '-'? NUMBER (('+' | '-') NUMBER)? | CONSTANT | ID ('.' ID)+) ':' aspattern | '**' ID
classarg: aspattern | ID '=' aspattern
""",
    ("3.8", "3.13"),
    _PY,
    {"ID": ("NAME", *PYTHON_SOFT), "CONSTANT": ("True", "False", "None"), "AUGMENTED": tuple(PYTHON_AUGMENTED), "COMPARE": ("<", ">", "<=", ">=", "==", "!="), "BINARY": tuple("+ - * / // % @ << >> & | ^".split())},
    {"group": 0, "call": 0, "index": 0, "statement": 1, "casesline": 1},
)
_PY_KIND = {w: _PY[w] for w in (*PYTHON_WORDS, *PYTHON_SOFT)}
_PY_OP = {w: _PY[w] for w in (*PYTHON_MARKS, *PYTHON_AUGMENTED)}
_P_NAME, _P_NUMBER, _P_STRING, _P_NL, _P_FSTRING, _P_BYTES, _P_IN, _P_OUT = (_PY[x] for x in ("NAME", "NUMBER", "STRING", "NL", "FSTRING", "BYTES", "IN", "OUT"))
_PREFIX = r"(?:[rR][bB]?|[bB][rR]?|[uU])?"
_PY_TOKEN = re.compile(
    rf"""[ \t\f]*+(?:(\r\n|\r|\n)|(\#[^\r\n]*)|(\\(?:\r\n|\r|\n))|((?:[fF][rR]?|[rR][fF])(?:\"\"\"|'''|"|'))
    |({_PREFIX}(?:\"\"\"(?:[^\\]|\\(?:.|\n))*?\"\"\"|'''(?:[^\\]|\\(?:.|\n))*?'''|"(?:[^"\\\r\n]|\\(?:\r\n|.|\n))*"|'(?:[^'\\\r\n]|\\(?:\r\n|.|\n))*'))
    |((?:[^\W\d]|[^\x00-\x7f])(?:\w|[^\x00-\x7f])*)
    |((?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![\w]))
    |(\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|<=|>=|==|!=|[()\[\]{{}},:;.=@+\-*/%&|^~<>])
    |(\Z)|(.))""",
    re.X | re.S,
)
_LEADING_ZERO = re.compile(r"0[\d_]*[1-9][\d_]*$")
_PY_PAIRS = {_PY[a]: _PY[b] for a, b in ("()", "[]", "{}")}
_PY_CLAUSES = {_PY[w] for w in ("elif", "else", "except", "finally")}
#: What matters in the text of a formatted string.
_LITERAL = re.compile(r"\\(?:\r\n|.)|\{\{|\}\}|[{}]|\r\n|[\r\n]|\"\"\"|'''|[\"']", re.S)
_ESCAPES = re.compile(r"\\(?:(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|[^xuUN])|(N\{[^}]*\})|(.))", re.S)


def _escapes(body: str, bytes_: bool) -> bool:
    """Whether the escapes of a literal are complete and their names known."""
    for m in _ESCAPES.finditer(body):
        if bytes_:
            if m[0][1] == "x" and not m[1]:
                return False
        elif m[3] or (m[2] and not _character(m[2][2:-1])):
            return False
    return True


def _character(name: str) -> bool:
    try:
        unicodedata.lookup(name)
    except KeyError:
        return False
    return True


def _formatted(text: str, at: int, quote: str, raw: bool, depth: int, spec: bool = False) -> int:
    """The place behind a formatted string whose text begins at `at`, or, with `spec`, that of the brace which ends a format
    specification; -1 if it isn't one."""
    if depth > 100:
        return -1
    start = at
    while m := _LITERAL.search(text, at):
        c = m[0]
        if c[0] == "\\":
            at = m.start() + 1 if c[1:] in ("{", "}") else m.end()
            if c[1:] == "N" and not raw and text[at : at + 1] == "{":
                at = text.find("}", at) + 1
                if not at:
                    return -1
            continue
        if c == "{{" and not spec or c == "}}" and not spec:
            at = m.end()
        elif c[0] in "\r\n":
            if len(quote) == 1:
                return -1
            at = m.end()
        elif c[0] == "}":
            return m.start() if spec and (raw or _escapes(text[start : m.start()], False)) else -1
        elif c[0] == "{":
            if not raw and not _escapes(text[start : m.start()], False):
                return -1
            at = start = _field(text, m.start() + 1, quote, raw, depth)
            if at < 0:
                return -1
        elif c == quote or (c[0] == quote[0] and len(c) > len(quote)):
            end = m.start() + len(quote)
            return end if not spec and (raw or _escapes(text[start : m.start()], False)) else -1
        else:
            at = m.end() if len(c) < 3 or c[0] != quote[0] else m.start() + 1
    return -1


def _field(text: str, at: int, quote: str, raw: bool, depth: int) -> int:
    """The place behind a replacement field whose expression begins at `at`, or -1."""
    found = _python_kinds(text, at, depth + 1)
    if found is None:
        return -1
    kinds, at = found
    if not PYTHON.accepts("field", kinds, *_python_extents(kinds)):
        return -1
    if text[at] == ":":
        at = _formatted(text, at + 1, quote, raw, depth + 1, spec=True)
    return at + 1 if at >= 0 else -1


def _python_kinds(text: str, at: int, field: int) -> tuple[str, int] | None:
    """The tokens of a module as kinds with line ends, indents and dedents, and where they end; with `field` the depth of a replacement field,
    those up to its end or its format specification. None for bad tokens or indentation."""
    out: list[str] = []
    stack, depth, first, line = [(0, 0)], int(field > 0), not field, at
    scan = _PY_TOKEN.scanner(text, at)
    add = out.append
    while m := scan.match():
        k = m.lastindex
        if k == 1:
            if not depth and not first:
                add(_P_NL)
                first = True
            line = m.end()
            continue
        if k == 2 or k == 3:
            if k == 3:
                if m.end() >= len(text):
                    return None
                line = m.end()
            continue
        if k == 9:
            break
        if first and not depth:
            first = False
            blank = text[line : m.start(k)]
            blank = blank[blank.rfind("\f") + 1 :]
            wide, narrow = len(blank.expandtabs(8)), len(blank.expandtabs(1))
            if (wide, narrow) != stack[-1]:
                if wide > stack[-1][0] and narrow > stack[-1][1]:
                    stack.append((wide, narrow))
                    add(_P_IN)
                elif wide < stack[-1][0]:
                    while stack[-1][0] > wide:
                        stack.pop()
                        add(_P_OUT)
                    if stack[-1] != (wide, narrow):
                        return None
                else:
                    return None
        if k == 6:
            if not m[6].isascii() and not m[6].isidentifier():
                return None
            add(_PY_KIND.get(m[6], _P_NAME))
        elif k == 8:
            x = m[8]
            if field and depth == 1 and (x == "}" or x[0] == ":"):
                return "".join(out), m.start(8)
            add(_PY_OP[x])
            if x in "([{":
                depth += 1
            elif x in ")]}" and depth:
                depth -= 1
        elif k == 5:
            s = m[5]
            prefix = s[:2].lower().split('"')[0].split("'")[0]
            if "b" in prefix and not s.isascii() or "r" not in prefix and not _escapes(s, "b" in prefix):
                return None
            add(_P_BYTES if "b" in prefix else _P_STRING)
        elif k == 4:
            prefix = m[4].rstrip("\"'")
            end = _formatted(text, m.end(), m[4][len(prefix) :], len(prefix) > 1, field)
            if end < 0:
                return None
            add(_P_FSTRING)
            scan = _PY_TOKEN.scanner(text, end)
        elif k == 7:
            if _LEADING_ZERO.match(m[7]):
                return None
            add(_P_NUMBER)
        elif field and depth == 1 and m[10] == "!":
            add(_PY["!"])
        else:
            return None
    if field or depth:
        return None
    if not first:
        add(_P_NL)
    out += [_P_OUT] * (len(stack) - 1)
    return "".join(out), len(text)


def _python_extents(kinds: str) -> tuple[list[int], list[int]]:
    """Of brackets, and of statements: to the end of their line or block, unless a block, a clause of the same statement or what
    a decorator decorates follows."""
    statements = [0] * (len(kinds) + 1)
    stack, line = [0], 0
    for k, c in enumerate(kinds):
        if c == _P_IN:
            stack.append(k + 1)
            line = k + 1
            continue
        if c == _P_OUT:
            if len(stack) == 1:
                break
            stack.pop()
            decorated = False
        elif c == _P_NL:
            decorated = kinds[line] == _PY["@"]
        else:
            continue
        after = kinds[k + 1 : k + 2]
        line = k + 1
        if after == _P_IN or after in _PY_CLAUSES or decorated:
            continue
        statements[stack[-1]] = k + 1
        stack[-1] = k + 1
    return brackets(kinds, _PY_PAIRS), statements


def python_module(text: str) -> frozenset[str]:
    found = _python_kinds(text, 0, 0)
    return frozenset() if found is None else PYTHON.accepts("file", found[0], *_python_extents(found[0]))


#: The check of each language, by file type.
LANGUAGES = {"cry": cryptol, "saw": sawscript, "py": python_module, "json": json_value}


def dialects(filetype: str, text: str) -> frozenset[str]:
    """The dialects of the file type's language under which the text is a file; a byte order mark is skipped."""
    return LANGUAGES[filetype](text[1:] if text[:1] == "﻿" else text)

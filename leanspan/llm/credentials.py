"""Credentials embedded in source code, configuration and prose (problem 3).

Configuration (env and properties files, INI, TOML, YAML, JSON, XML, Dockerfiles and
shell scripts) is parsed into key paths with the offsets of their values; source code
gives its string literals with the name each is assigned to, joined over
concatenations.  A value is a credential when its key path has a sensitive name and the
value has the shape of one, or when its own form says so: a private key, a login in a
URL, header, connection string or command, a token with an issuer's prefix, or an
encoded login.  Comments and prose are read for the same forms.  Redactions are spliced
into the original bytes: each masked character becomes ``*``, line ends stay, and
nothing else changes.

The chunks of a file are put together and searched as one text, so that a chunk border
hides nothing; places are mapped back to the chunk and line in which they begin, and a
place that goes on is masked in the following chunks too.

Defined results: chunks without id or content give nothing; chunks without a file stand
alone, and a gap in the bytes of a file parts its text; a null path is read as prose
with code; null start lines count from line 1; damaged configuration is read as far as
it goes; a private key whose beginning is missing is masked but not reported; one whose
end is missing is masked to the end of its base64 lines; equal deliveries count once;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE_SCHEMA = "chunk_id long, line_no long, key string, kind string, start_byte long, end_byte long"
REDACTED_SCHEMA = "chunk_id long, file_id long, places int, content string"

# --- names -------------------------------------------------------------------
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_STRONG = {"password", "passwd", "passphrase", "pwd", "secret", "credential", "credentials", "apikey", "passcode", "pass"}
_PAIRS = {("api", "key"), ("access", "key"), ("signing", "key"), ("private", "key"), ("secret", "key"), ("encryption", "key"), ("account", "key"), ("auth", "key"), ("master", "key"), ("shared", "key"), ("service", "key"), ("license", "key"), ("webhook", "key"), ("hmac", "key"), ("access", "token"), ("auth", "token"), ("api", "token"), ("refresh", "token"), ("bearer", "token"), ("session", "token"), ("deploy", "token"), ("bot", "token"), ("security", "token"), ("secret", "token")}
_LOOSE = {"token", "tokens", "auth", "bearer", "authorization", "login", "pat", "jwt", "cookie"}
_NOT = {"prompt", "help", "field", "fields", "encoding", "count", "max", "min", "limit", "budget", "length", "len", "size", "name", "names", "label", "hint", "policy", "hash", "digest", "checksum", "id", "ids", "type", "kind", "url", "uri", "endpoint", "path", "ttl", "expiry", "expires", "expiration", "format", "pattern", "regex", "header", "scope", "scopes", "issuer", "enabled", "required", "public", "rotation", "version", "description", "doc", "docs", "message", "error", "title", "placeholder"}


def sensitivity(path: str) -> int:
    """2: the key path names a credential; 1: it may; 0: it does not."""
    parts = path.split("/")
    leaf = parts[-1]
    if len(parts) > 1 and leaf.lower() in ("key", "token", "secret"):
        leaf = f"{parts[-2]}_{leaf}"  # signing.key, auth: {token: ...}
    words = [w.lower() for w in _WORDS.findall(leaf)]
    # numbered and lettered variants of a name (passwordb, keyc) count as the name
    words = [w[:-1] if w[:-1] in _STRONG or w[:-1] in ("key", "token") and w[-1] != "s" else w for w in words]
    if not words:
        return 0
    if set(words) & _NOT and not (words[-1] in ("file", "value")):
        return 0
    if set(words) & _STRONG or any(p in _PAIRS for p in zip(words, words[1:])):
        return 2
    if set(words) & _LOOSE:
        return 1
    # the name of an enclosing object counts for members such as value or data
    if words[-1] in ("value", "data", "default", "literal") and "/" in path:
        return sensitivity(path.rsplit("/", 1)[0])
    return 0


# --- values ------------------------------------------------------------------
_REFERENCE = re.compile(
    r"^(?:\$\{?[A-Za-z_(]|\$\$|\{\{|<%|%\w+%|<[^<>]*>$|&lt;|\[[^\]]*\]$|vault:|secret:|secrets?[./]|ref\+|arn:|ssm:|sm://|gcp-?sm:|azurekv|keyvault|op://|env:|env\.|file:|/|\./|~|@|process\.env|os\.|System\.|std::|env!|getenv|ENV\[|config[.\[]|settings[.\[]|self\.|this\.|https?://|ssh-|!(?:Ref|Sub|GetAtt|vault|secret))", re.I
)
_PLACEHOLDER = re.compile(
    r"^(?:[x*.#\-_?•]+|x{3,}.*|(?:your|my|some|the|insert|enter|put|add|set|replace|change|fill|use)[-_ ]?.*(?:here|me|please|token|key|secret|password|value|it)?|change_?me.*|changeit|example.*|.*example|sample.*|dummy.*|placeholder.*|redacted.*|.*redacted|hidden|masked|todo.*|tbd|fixme|none|null|nil|undefined|true|false|yes|no|on|off|test|testing|default|unset|empty|secret|password|passwd|token|n/?a|\.\.\.)$", re.I
)
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_DIGEST = re.compile(r"^(?:sha\d+|md5|h1|blake\d\w*)[-:]", re.I)
_PHRASE = re.compile(r"^[a-z]+(?:[-_.][a-z]+){2,}[-_.]?\d{1,6}$", re.I)
#: prefixes that issuers give their tokens (fixed values)
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w\-]{18,}|(?:AKIA|ASIA)[A-Z0-9]{16}|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abeprs]-[A-Za-z0-9\-]{16,}|eyJ[\w\-]{8,}\.eyJ?[\w\-]{8,}\.[\w\-]{8,}|AIza[\w\-]{35}|ya29\.[\w\-]{20,}|sk-(?:proj-|ant-)?[A-Za-z0-9_\-]{24,}|npm_[A-Za-z0-9]{30,}|pypi-[\w\-]{40,}|hf_[A-Za-z0-9]{30,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|dop_v1_[0-9a-f]{40,}|shpat_[0-9a-f]{32}|[a-z]{2,10}-pat-[A-Za-z0-9]{16,}|[a-z]{2,8}tk_[0-9a-f]{32}|ltk_[0-9a-f]{32})(?![A-Za-z0-9_])"
)


def _switches(v: str) -> int:
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "." for c in v]
    return sum(x != y and (x, y) != ("A", "a") for x, y in zip(kinds, kinds[1:]))


def is_placeholder(v: str) -> bool:
    return not v or bool(_REFERENCE.match(v) or _PLACEHOLDER.match(v)) or len(set(v)) < 4


def shaped(v: str, level: int) -> bool:
    """Whether a value has the shape of a credential; level is the key's sensitivity."""
    if len(v) < (6 if level == 2 else 16) or re.search(r"\s", v) or is_placeholder(v):
        return False
    if _UUID.match(v) or _DIGEST.match(v):
        return False
    letters, digits = sum(c.isalpha() for c in v), sum(c.isdigit() for c in v)
    if not letters:
        return False
    if re.search(r"[(){}\[\];<>]|::|->", v) or re.match(r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$", v) and not digits:
        return False
    if re.match(r"^[a-z]+[-_][0-9a-f]{4,8}$", v):  # a name with a short revision
        return False
    if _PHRASE.match(v):
        return True
    if digits and letters:
        if re.match(r"^[a-z]+[-_/.]?v?\d+(?:[-_.][a-z]+)*$", v):  # words with a number, such as a version or model
            return level == 2 and len(v) >= 16 and _switches(v) >= 4
        return digits >= 2 or _switches(v) >= 4 or bool(re.search(r"[!@#$%^&*?~+=]", v))
    special = bool(re.search(r"[!@#$%^&*?~+=]", v))
    upper, lower = sum(c.isupper() for c in v), sum(c.islower() for c in v)
    if level == 2 and len(v) >= 8 and upper > 2 and lower > 2:
        pieces = re.findall("[A-Z][a-z]*|[a-z]+", v)
        if sum(map(len, pieces)) <= 3.2 * len(pieces):
            return True
    return upper > 1 and lower > 1 and (_switches(v) >= 3 or special and len(v) >= 8)


def _login_encoded(v: str) -> bool:
    """Whether a value is base64 of ``user:password`` with a password."""
    if len(v) < 12 or len(v) % 4 or not re.match(r"^[A-Za-z0-9+/]+={0,2}$", v):
        return False
    try:
        text = base64.b64decode(v, validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    m = re.match(r"^([\w.\-@]{2,}):(\S{6,})$", text)
    return bool(m) and text.isprintable() and not is_placeholder(m[2])


# --- forms that speak for themselves -----------------------------------------
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/]{40,}")
#: what follows BEGIN in a key whose END is missing: lines of base64 with their quotes, comment marks and line ends, after headers such as DEK-Info
_PEM_GAP = r"(?:\\[nrt]|[\s\"'`,;>|\\]|(?<=[\s\"'`])[+*#.&](?=[\s\"'`])|//(?=[ \t]))*+"
_PEM_OPEN = re.compile(
    r"(?:" + _PEM_GAP + r"(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):[^\n\\\"'`]*+|[A-Za-z0-9+/]{24,}+={0,2}))*+"
    # a last line that is shorter: padded, at the end of the text, or with the look of base64
    r"(?:" + _PEM_GAP + r"(?:[A-Za-z0-9+/]{2,23}={1,2}|[A-Za-z0-9+/]{1,23}(?=\s*\Z)|(?=[a-z0-9+/]*[A-Z])(?=[A-Za-z+/]*\d)(?:[A-Za-z0-9+/]{4}){1,5}(?=\\n|[\s\"'`])))?(?:" + _PEM_GAP + r"=[A-Za-z0-9+/]{4}(?![A-Za-z0-9+/=]))?"
)
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]{1,20}://([^\s:/@\"'`<>]*+):([^\s/@\"'`<>]++)@(?=[\w\[.\-])")
_HEADER = re.compile(r"(?i)\b(?:bearer|token)[ \t]+([A-Za-z0-9\-._~+/]{16,}=*)|\bbasic[ \t]+([A-Za-z0-9+/]{8,}={0,2})|\b(?:x-[a-z\-]*(?:key|token|secret)|private-token)[ \t]*:[ \t]*([^\s\"'`;,]{8,})")
_PAIR = re.compile(r"(?i)(?<![\w.\-])(password|passwd|pwd|passphrase|accountkey|sharedaccesskey|sharedaccesskeyname|secret|client_secret|api_?key|access_?token|auth_?token|private_?key|secret_?key)[ \t]*=[ \t]*([^\s\"'`;,&<>]{4,})")
_COMMAND = re.compile(r"(?i)(?:(?<![\w\-])(?:-u|--user|--proxy-user)[ =]['\"]?[\w.\-@]+:([^\s'\"@]{4,})|(?<![\w\-])--?(?:password|passwd|pass|token|api-?key|secret)[ =]['\"]?([^\s'\"]{4,})|\bsshpass[ \t]+-p[ \t]*['\"]?([^\s'\"]{4,})|\b(?:mysql|mysqldump|mariadb)\b[^\n]*?[ \t]-p([^\s'\"]{4,})|\bPGPASSWORD=['\"]?([^\s'\"]{4,}))")
_SPOKEN = re.compile(
    r"(?i)\b(?:was|old|new|current|previous|temporary|temp|default|staging|production|prod|dev|test|admin|root|service|use|the|with|set|is|my|our|shared|backup)?[ \t:]*\b((?:[a-z]+[_\-. ]?)?(?:password|passwd|pwd|passphrase|secret|token|credentials?|api[_\- ]?key|access[_\- ]?key|signing[_\- ]?key|private[_\- ]?key|key|login|pat)(?:[_\-][a-z]+)?)\b[ \t]*(?:is|was|=|:|->|→|for[ \t]+[\w.\-]+[ \t]*[:=])?[ \t]*[`'\"(]?([^\s`'\"()<>,;]{8,})"
)
_SPOKEN_LOGIN = re.compile(r"(?i)\b(?:login|log in|credentials?|creds|account|user(?:name)?)\b[^\n:=]{0,30}[:=][ \t]*([\w.\-@]+)[ \t]*(?:/|:|,[ \t]*(?:password|pw|pass)[ \t]*[:=]?)[ \t]*([^\s,;\"'`<>]{6,})")

_CONFIG = re.compile(r"\.(?:ya?ml|json|jsonc|json5|toml|ini|cfg|conf|config|properties|env|xml|sh|bash|zsh|tfvars|lock|sum)$|(?:^|/)(?:Dockerfile[\w.\-]*|\.env[\w.\-]*|\.npmrc|\.netrc|\.pypirc|\w+\.env)$", re.I)
_PROSE = re.compile(r"\.(?:md|markdown|rst|txt|adoc|html?|css)$", re.I)
_LOCKED = re.compile(r"(?:^|/)(?:go\.sum|[\w.\-]*\.lock|package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml)$", re.I)
_CODE_COMMENT = re.compile(r"(?<![:\w\"'`])//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|(?:(?<=\s)|(?<![\s\S]))(?:#|--)[^\n]*|<!--(?:[^-]|-(?!->))*-->")

Item = tuple[str, str, int, int]  # key path, value, start, end


def parse_lines(text: str) -> Iterator[Item]:
    """env, properties, INI, TOML, Dockerfile and shell: key paths of assignments."""
    section = ""
    at = 0
    for line in text.splitlines(keepends=True):
        m = re.match(r"[ \t]*\[+([^\]\n]+)\]+[ \t]*(?:[#;].*)?$", line.rstrip("\r\n"))
        if m:
            section = m[1].strip() + "/"
        elif not line.lstrip().startswith(("#", ";", "//", "!")):
            m = re.match(r"[ \t]*(?:export[ \t]+|set[ \t]+|ENV[ \t]+|ARG[ \t]+|declare[ \t]+(?:-\w+[ \t]+)?|local[ \t]+|readonly[ \t]+)?[\"']?([A-Za-z_][\w.\-]*)[\"']?[ \t]*[=:][ \t]*", line) or re.match(r"[ \t]*(?:ENV|ARG)[ \t]+([A-Za-z_]\w*)[ \t]+", line)
            if m:
                rest = line[m.end():].rstrip("\r\n")
                q = re.match(r"\"((?:[^\"\\]|\\.)*)\"|'([^']*)'|([^\s#;][^\r\n]*?)(?=[ \t]+[#;]|[ \t]*$)", rest)
                if q:
                    g = 1 if q[1] is not None else 2 if q[2] is not None else 3
                    yield section + m[1].replace(".", "/") if "." in m[1] else section + m[1], q[g], at + m.end() + q.start(g), at + m.end() + q.end(g)
        at += len(line)


def parse_yaml(text: str) -> Iterator[Item]:
    """Key paths of scalars by indentation; block scalars are one value."""
    stack: list[tuple[int, str]] = []
    lines = text.splitlines(keepends=True)
    at, n = 0, 0
    while n < len(lines):
        line = lines[n]
        m = re.match(r"([ \t]*(?:-[ \t]+)*)[\"']?([\w.\-/]+)[\"']?[ \t]*:(?:[ \t]+|(?=\r?\n|$))", line)
        if m and not line.lstrip().startswith("#"):
            depth = len(m[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            path = "/".join([k for _, k in stack] + [m[2]])
            stack.append((depth, m[2]))
            rest = line[m.end():].rstrip("\r\n")
            block = re.match(r"[|>][+\-\d]*[ \t]*$", rest)
            if block:
                begin = at + len(line)
                end = begin
                while n + 1 < len(lines) and (not lines[n + 1].strip() or len(lines[n + 1]) - len(lines[n + 1].lstrip(" ")) > depth):
                    n += 1
                    at += len(line)
                    line = lines[n]
                    end = at + len(line)
                yield path, text[begin:end], begin, end
            else:
                q = re.match(r"(?:![\w!]+[ \t]+)?(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^']|'')*)'|([^\s#\[{&*|>][^\r\n]*?)(?=[ \t]+#|[ \t]*$))", rest)
                if q:
                    g = 1 if q[1] is not None else 2 if q[2] is not None else 3
                    yield path, q[g], at + m.end() + q.start(g), at + m.end() + q.end(g)
        at += len(line)
        n += 1


_JSON = re.compile(r'"((?:[^"\\\n]|\\.)*)"|([{}\[\],:])')


def parse_json(text: str) -> Iterator[Item]:
    """Key paths of string values; a chunk may begin inside any object."""
    path: list[str] = []
    key, after = "", False
    for m in _JSON.finditer(text):
        if m[2]:
            c = m[2]
            if c in "{[":
                path.append(key)
                key, after = ("", False) if c == "{" else (key, False)
            elif c in "}]":
                if path:
                    path.pop()
                key, after = "", False
            elif c == ":":
                after = True
            else:
                after = False
        elif after or not re.match(r"\s*:", text[m.end(): m.end() + 20]):
            yield "/".join([p for p in path if p] + [key or (path[-1] if path else "")]), m[1], m.start(1), m.end(1)
            after = False
        else:
            key = m[1]


_XML = re.compile(r"<([\w:.\-]+)((?:\s+[\w:.\-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>(?:([^<]*)</\1>)?")
_ATTR = re.compile(r"([\w:.\-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def parse_xml(text: str) -> Iterator[Item]:
    """Elements by tag, and name/value or key/value attribute pairs."""
    for m in _XML.finditer(text):
        attrs = {a[1].lower(): a for a in _ATTR.finditer(text, m.start(2), m.end(2))}
        named = next((attrs[k] for k in ("name", "key", "id", "property") if k in attrs), None)
        for k, a in attrs.items():
            g = 2 if a[2] is not None else 3
            if k in ("value", "val", "content") and named is not None:
                yield m[1] + "/" + (named[2] or named[3] or ""), a[g], a.start(g), a.end(g)
            elif a is not named:
                yield m[1] + "/" + a[1], a[g], a.start(g), a.end(g)
        if m[4] and m[4].strip():
            s = m[4]
            a = m.start(4) + len(s) - len(s.lstrip())
            yield (m[1] + "/" + (named[2] or named[3]) if named is not None else m[1]), s.strip(), a, a + len(s.strip())


_LITERAL = r"(?:[rbuRBULf8]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|r#*\"[^\"]*\"#*)"
_ASSIGNED_HEAD = r"([A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*)(?!::)[\"']?\]?[ \t]*(?:<[^<>\n]*>)?(?:[ \t]*:(?!:)[ \t]*[^=;\n\"'`]{0,200}?)?[ \t]*(?::=|=>|=|:|\()[ \t\n]*(?:concat!\(|String::from\(|std::string\(|new String\(|\()?[ \t\n]*"
_ASSIGNED = re.compile(_ASSIGNED_HEAD + "(" + _LITERAL + r"(?:[ \t\n]*[+,]?[ \t\n]*(?:\\\n[ \t]*)?" + _LITERAL + r")*+)")
#: where such an assignment begins; its literals are read from there, however long they are
_BEGUN = re.compile(_ASSIGNED_HEAD + r"(?=[rbuRBULf8]{0,2}[\"'`]|r#*\")")
_NEXT = re.compile(r"\s*(?:(?:concat!|String::from|std::string|new String)?\(\s*)?[rbuRBULf8]{0,2}#*[\"'`]?")
_PIECE = re.compile(_LITERAL)


def _inner(s: str) -> tuple[int, int]:
    """Where the text of a literal begins and ends in it."""
    a = re.match(r"[A-Za-z8]{0,2}#*(\"\"\"|'''|\"|'|`)", s)
    b = len(s) - len(a[1]) - (len(s) - len(s.rstrip("#")) if s.endswith("#") else 0)
    return a.end(), max(a.end(), b)


def _assigned(m: re.Match) -> tuple[str, str, list[tuple[int, int]]]:
    """The name, the joined text and the parts' offsets of a match of _ASSIGNED."""
    parts, values = [], []
    joined = m[2]
    for k, p in enumerate(_PIECE.finditer(joined)):
        if k and "concat!" not in m[0] and re.search(r",[ \t\n]*$", joined[: p.start()]):
            break
        a, b = _inner(p.group())
        parts.append((m.start(2) + p.start() + a, m.start(2) + p.start() + b))
        values.append(p.group()[a:b])
    return m[1], "".join(values), parts


def parse_code(text: str) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """Names that string literals are assigned to, their joined text, and the parts' offsets."""
    for m in _ASSIGNED.finditer(text):
        yield _assigned(m)


#: lower-case substrings that a line must hold for a form to be on it
_NAMED = ("pass", "pwd", "secret", "token", "key", "cred", "login", "auth", "pat", "account", "user", "cookie", "jwt", "bearer")
_PREFIXES = ("gh", "akia", "asia", "k_live_", "k_test_", "xox", "eyj", "glpat", "aiza", "ya29", "sk-", "npm_", "pypi-", "hf_", "sg.", "dop_v1_", "shpat_", "-pat-", "tk_", "github_pat_")
_COMMANDS = ("-u", "--user", "--pass", "-p", "--token", "--api", "--secret", "-pass", "pgpassword", "-token", "-secret")
_HEADERS = ("bearer", "token", "basic", "x-")
_JOINED = ('" +', "' +", "` +", "concat!", '"+', "'+", '" "')


class Finder:
    """Collects the places of one text; overlapping finds are one place."""

    def __init__(self, text: str, path: str | None):
        self.text, self.path = text, path or ""
        low = text.lower()
        # some letters change length in lower case; ASCII alone matters here
        self.low = low if len(low) == len(text) else re.sub("[A-Z]+", lambda m: m.group().lower(), text)
        self.found: list[tuple[int, int, str, str]] = []
        # disjoint intervals in order
        self.begins: list[int] = []
        self.ends: list[int] = []

    def cover(self, a: int, b: int) -> None:
        i, j = bisect_left(self.ends, a), bisect_right(self.begins, b)
        if i < j:
            a, b = min(a, self.begins[i]), max(b, self.ends[j - 1])
        self.begins[i:j], self.ends[i:j] = [a], [b]

    def add(self, a: int, b: int, key: str, kind: str) -> None:
        k = bisect_right(self.ends, a)
        if b > a and not (k < len(self.begins) and self.begins[k] < b):
            self.found.append((a, b, key, kind))
            self.cover(a, b)

    def run(self) -> list[tuple[int, int, str, str]]:
        text, path = self.text, self.path
        if _LOCKED.search(path):
            # dependency locks hold digests; only forms that speak for themselves count
            self.keys()
            self.forms()
            return sorted(self.found)
        self.keys()
        if path.lower().endswith((".yaml", ".yml")):
            items = parse_yaml(text)
        elif path.lower().endswith((".json", ".jsonc", ".json5")):
            items = parse_json(text)
        elif path.lower().endswith(".xml"):
            items = parse_xml(text)
        elif _CONFIG.search(path) or not path:
            items = parse_lines(text)
        else:
            items = ()
        for key, value, a, b in items:
            self.value(key, value, [(a, b)])
        if not _CONFIG.search(path) and not _PROSE.search(path):
            self.code()
        self.forms()
        prose = bool(_PROSE.search(path))
        for a, b in self.lines(_NAMED):
            line = text[a:b]
            if prose:
                self.spoken(line, a)
            elif "//" in line or "#" in line or "--" in line or "*" in line:
                for m in _CODE_COMMENT.finditer(line):
                    self.spoken(m.group(), a + m.start())
                if re.match(r"[ \t]*\*", line):
                    self.spoken(line, a)
        return sorted(self.found)

    def value(self, key: str, value: str, parts: list[tuple[int, int]]) -> None:
        if not value or "PRIVATE KEY-----" in value or "PUBLIC KEY-----" in value:
            return
        level = sensitivity(key)
        kind = ""
        if level and shaped(value, level):
            kind = "value"
        elif _ISSUED.fullmatch(value):
            kind = "issued"
        elif _login_encoded(value):
            kind = "encoded"
        if kind:
            free = [p for p in parts if p[1] > p[0]]
            if free:
                self.add(*free[0], key, kind)
                for a, b in free[1:]:
                    self.cover(a, b)
                    self.found.append((a, b, key, "rest"))

    def keys(self) -> None:
        text = self.text
        begins, ends = list(_PEM.finditer(text)), list(_PEM_END.finditer(text))
        stops = [e.start() for e in ends]
        for m, n in zip(begins, [*begins[1:], None]):
            k = bisect_left(stops, m.end())
            e = ends[k] if k < len(ends) and (not n or stops[k] < n.start()) else None
            end = e.start() if e else _PEM_OPEN.match(text, m.end(), n.start() if n else len(text)).end()
            if _PEM_BODY.search(text, m.end(), end):
                self.found.append((m.start(), end, "", "private key"))
                self.cover(m.start(), e.end() if e else end)
        if ends and not (begins and begins[0].start() < stops[0]):
            # the end of a key whose beginning is missing: the base64 lines before it
            parts, begin = re.split(r"(\\n|\r?\n)", text[: stops[0]]), stops[0]
            while parts:
                part = parts.pop()
                bare = part.strip(" \t")
                if not part.strip() or part == "\\n" or len(bare) >= 16 and not bare.strip(_BASE64):
                    begin -= len(part)
                    continue
                run = len(bare) - len(bare.rstrip(_BASE64))
                if run >= 16 and part.endswith(bare):
                    begin -= run
                break
            if _PEM_BODY.search(text, begin, stops[0]):
                self.found.append((begin, stops[0], "", "rest"))
                self.cover(begin, ends[0].end())

    def lines(self, marks: tuple[str, ...]) -> list[tuple[int, int]]:
        """The lines that hold one of the marks, in order."""
        low, n = self.low, len(self.low)
        found = {}
        for mark in marks:
            at = low.find(mark)
            while at >= 0:
                end = low.find("\n", at)
                end = n if end < 0 else end
                found[low.rfind("\n", 0, at) + 1] = end
                at = low.find(mark, end)
        return sorted(found.items())

    def code(self) -> None:
        """Literals assigned to sensitive names, and joined literals whatever their name."""
        text = self.text
        seen = set()
        for a, b in self.lines(_NAMED):
            line = self.low[a:b]
            if '"' in line or "'" in line or "`" in line or line.rstrip().endswith(("=", "(", ":")):
                seen.add((a, b))
        joined = self.lines(_JOINED)
        for a, b in sorted(seen | set(joined)):
            at, end = a, _NEXT.match(text, b).end()
            while (m := _BEGUN.search(text, at, end)) and m.start() < b:
                whole = _ASSIGNED.match(text, m.start())
                if whole:
                    self.value(*_assigned(whole))
                at = whole.end() if whole else m.end()

    def forms(self) -> None:
        text = self.text
        for a, b in self.lines(("://",)):
            for m in _URL.finditer(text, a, b):
                if not is_placeholder(m[2]) and shaped(m[2], 2):
                    self.add(*m.span(2), "url", "url")
        for a, b in self.lines(_PREFIXES):
            for m in _ISSUED.finditer(text, a, b):
                self.add(*m.span(), "", "issued")
        for a, b in self.lines(_HEADERS):
            for m in _HEADER.finditer(text, a, b):
                if m[1] and shaped(m[1], 1):
                    self.add(*m.span(1), "bearer", "header")
                elif m[2] and _login_encoded(m[2]):
                    self.add(*m.span(2), "basic", "header")
                elif m[3] and shaped(m[3], 2):
                    self.add(*m.span(3), "header", "header")
        for a, b in self.lines(_NAMED):
            for m in _PAIR.finditer(text, a, b):
                if m[2][0] not in "([{" and shaped(m[2], 2):
                    self.add(*m.span(2), m[1], "pair")
        for a, b in self.lines(_COMMANDS):
            for m in _COMMAND.finditer(text, a, b):
                g = next(k for k in range(1, 6) if m[k])
                if shaped(m[g], 2):
                    self.add(*m.span(g), "command", "command")

    def spoken(self, text: str, at: int) -> None:
        for m in _SPOKEN_LOGIN.finditer(text):
            if shaped(m[2].rstrip(".") if m[2].count(".") == 1 else m[2], 2):
                self.add(at + m.start(2), at + m.end(2), m[1], "login")
        for m in _SPOKEN.finditer(text):
            v = m[2].rstrip(".:")
            if "public" in m[1].lower() or v.startswith("--"):
                continue
            if sensitivity(m[1].replace(" ", "_")) or m[1].lower().endswith("key"):
                strong = len(v) >= 10 and shaped(v, 2) and (_switches(v) >= 3 or _PHRASE.match(v) or len(v) >= 20)
                if strong:
                    self.add(at + m.start(2), at + m.start(2) + len(v), m[1], "spoken")


def find(text: str, path: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, key, kind) of each place, in code points; kind ``rest`` continues an earlier place."""
    return Finder(text, path).run()


def mask(text: str, places: list[tuple[int, int, str, str]]) -> str:
    """The text with every character of the places but line ends masked."""
    out, at = [], 0
    for a, b, _, kind in sorted(places):
        if b <= at:
            continue
        a = max(a, at)
        secret = text[a:b]
        if "PRIVATE KEY-----" in secret:
            cut = secret.index("PRIVATE KEY-----") + 16
            out.append(text[at:a] + secret[:cut])
            a += cut
        else:
            out.append(text[at:a])
        # escapes of line ends inside literals stay whole
        out.append(re.sub(r"(\\n|\\r|[\r\n\t ])|.", lambda m: m[1] or "*", text[a:b]))
        at = b
    out.append(text[at:])
    return "".join(out)


def _texts(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, path, parts: the chunks of each file, and each chunk without a file, with the file's path; of the files only ids and paths are read."""
    byte = F.col("start_byte") if "start_byte" in chunks.columns else F.lit(None).cast("long")
    part = F.struct(byte.alias("start_byte"), F.col("id").alias("id"), F.col("content").alias("content"), F.col("start_line").alias("start_line"))
    c = chunks.filter(F.col("id").isNotNull() & F.col("content").isNotNull())
    p = files.filter(F.col("id").isNotNull()).select(F.col("id").alias("file_id"), "path").dropDuplicates(["file_id"])
    own = c.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.sort_array(F.collect_list(part)).alias("parts")).join(p, "file_id", "left")
    alone = c.filter(F.col("file_id").isNull()).select("file_id", F.array(part).alias("parts"), F.lit(None).cast("string").alias("path"))
    return own.select("file_id", "parts", "path").unionByName(alone)


def _runs(parts: list) -> Iterator[list]:
    """The chunks of a file, each once, in runs without a gap in their bytes."""
    seen, run, end = set(), [], None
    if any(pd.isna(p["start_byte"]) for p in parts):
        parts = sorted(parts, key=lambda p: p["id"])
    for p in parts:
        if p["id"] in seen:
            continue
        seen.add(p["id"])
        at = None if pd.isna(p["start_byte"]) else int(p["start_byte"])
        if run and at is not None and end is not None and at != end:
            yield run
            run = []
        run.append(p)
        end = None if at is None else at + len(p["content"].encode("utf-8", "surrogatepass"))
    if run:
        yield run


def places_of(run: list, path: str | None) -> list[tuple]:
    """PLACE_SCHEMA rows of the chunks of one text: each place where it begins, its end cut to that chunk."""
    text = "".join(p["content"] for p in run)
    starts, at = [], 0
    for p in run:
        starts.append(at)
        at += len(p["content"])
    out, ends = [], {}
    for a, b, key, kind in find(text, path):
        if kind == "rest":
            continue
        k = bisect_right(starts, a) - 1
        part = run[k]["content"]
        if k not in ends:
            ends[k] = [m.start() for m in re.finditer("\n", part)]
        a, b = a - starts[k], min(b - starts[k], len(part))
        first = 1 if pd.isna(run[k]["start_line"]) else int(run[k]["start_line"])
        out.append((run[k]["id"], first + bisect_left(ends[k], a), key, kind, len(part[:a].encode("utf-8", "surrogatepass")), len(part[:b].encode("utf-8", "surrogatepass"))))
    return out


def masked_chunks(run: list, path: str | None) -> list[tuple]:
    """(chunk, places that begin in it, content) of the chunks of one text that hold a place or a part of one."""
    text = "".join(p["content"] for p in run)
    places = find(text, path)
    if not places:
        return []
    hidden = mask(text, places)
    starts, at = [], 0
    for p in run:
        starts.append(at)
        at += len(p["content"])
    count: dict[int, int] = {}
    for a, b, _, kind in places:
        first = bisect_right(starts, a) - 1
        count[first] = count.get(first, 0) + (kind != "rest")
        for k in range(first + 1, bisect_left(starts, b)):
            count.setdefault(k, 0)
    return [(run[k]["id"], n, hidden[starts[k]: starts[k] + len(run[k]["content"])]) for k, n in sorted(count.items())]


def find_secrets(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """PLACE_SCHEMA: every place of a credential, once for each chunk and line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for parts, path in zip(batch["parts"], batch["path"]):
                for own in _runs(parts):
                    out += places_of(own, path)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PLACE_SCHEMA.split(", ")])

    return _texts(chunks, files).mapInPandas(run, PLACE_SCHEMA)


def redact(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """REDACTED_SCHEMA: the chunks that held credentials, with them masked and every other byte as it was."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, parts, path in zip(batch["file_id"], batch["parts"], batch["path"]):
                for own in _runs(parts):
                    out += [(chunk, None if pd.isna(file) else file, n, text) for chunk, n, text in masked_chunks(own, path)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REDACTED_SCHEMA.split(", ")]).astype({"file_id": "Int64"})

    return _texts(chunks, files).mapInPandas(run, REDACTED_SCHEMA).dropDuplicates(["chunk_id"])

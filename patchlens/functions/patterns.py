"""The patterns, names and hosts that rules look for, as Java regular expressions."""

# Markers of text that is aimed at the reviewer.
INJECTION = r"(?iu)(ignore\s+(all\s+)?(previous|prior)\s+instructions|you\s+are\s+now|disregard\s+the\s+above|risk[_\s]?score\s*(=|:|to)\s*0|pre-?approved|reviewer[-\s]?bot|system\s*:)"
# What a text must have, in lower case, for a marker to be in it: all words of one of these.
INJECTION_WORDS = (("disregard", "above"), ("reviewer", "bot"), ("approved",), ("ignore", "instructions"), ("system",), ("risk", "score"), ("now", "you", "are"))
EXEMPT_PATH = r"(?iu)(^|/)(samples|tests|fixtures|testdata|prompts)/"
# Where to look first.
HIGH_RISK_PATH = r"(?iu)(\.github/workflows/|(^|/)Dockerfile|\.sh$|(^|/)package\.json$|(^|/)requirements\.txt$|(^|/)go\.mod$|\.ya?ml$)"
KEYWORD = r"(?iu)(eval|exec|base64|subprocess|os\.system|urllib|requests|socket|token|secret|password|curl)"
KEYWORD_WORDS = tuple((w.replace("\\.", "."),) for w in KEYWORD.removeprefix("(?iu)(").removesuffix(")").split("|"))
# Letters beyond ASCII that a pattern without case, as Unicode has it, takes for one of a to z: i twice, s and k.
FOLDED = "\u0130\u0131\u017f\u212a"
# What isn't reviewed by policy, and build output.
EXCLUDED_PATH = r"(?iu)(^|/)(node_modules|vendor|third_party|\.venv|__pycache__|__snapshots__|testdata|\.terraform|Pods)/|\.min\.js$|\.min\.css$|\.js\.map$|\.snap$|\.log$|_pb2\.py$|\.pb\.go$|\.generated\."
BUILD_PATH = r"(?iu)(^|/)(dist|build|out|target)/"
# Lockfiles and the manifest that changes with each.
MANIFESTS = {
    "package-lock.json": "package.json",
    "yarn.lock": "package.json",
    "pnpm-lock.yaml": "package.json",
    "poetry.lock": "pyproject.toml",
    "uv.lock": "pyproject.toml",
    "Cargo.lock": "Cargo.toml",
    "go.sum": "go.mod",
    "composer.lock": "composer.json",
    "Gemfile.lock": "Gemfile",
    "Pipfile.lock": "Pipfile",
}
# Package registries.
HOSTS = ("npmjs.org", "npmjs.com", "yarnpkg.com", "pythonhosted.org", "pypi.org", "crates.io", "golang.org", "rubygems.org", "maven.apache.org", "github.com", "githubusercontent.com", "packagist.org")
# An address in a lockfile, a dependency from elsewhere, and how many findings a lockfile has at most.
URL = r"https?://[A-Za-z0-9._~\-]+"
OFF_REGISTRY = r"(?iu)(git\+[a-z0-9.+\-]*://|(?<![A-Za-z])git://|(?<![A-Za-z])ssh://|(?<![A-Za-z0-9_])(?:file|link):(?=[./~]))"
MAX_LOCK_FINDINGS = 25

# A file's header, the ends of lines, what is deleted, the mark of a cut file, an object in prose.
HEADER = r"^diff --git a/(.*?) b/(.*?)\s*$"
# The same, with either path in quotes.
QUOTED_HEADER = r'''^diff --git (?:"a/((?:[^"\\]|\\.)*+)"|a/(.*?)) (?:"b/((?:[^"\\]|\\.)*+)"|b/(.*?))\s*$'''
LINE_ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
#: The same as characters.
ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# Line ends other than line feeds: those of Latin-1, which Java looks up in a table of bits, and the others.
OTHER_LINE_END, OTHER_LINE_ENDS = r"[\r\x0b\x0c\x1c\x1d\x1e\x85]", ("\u2028", "\u2029")
LINE = rf"[^{LINE_ENDS}]*(?:\r\n|[{LINE_ENDS}])|[^{LINE_ENDS}]+"
# The place behind a line's end, a file's header as HEADER has it, where a file begins, and where a hunk begins or ends. Letters are looked at first, as most places have others.
LINE_START = rf"(?<=[{LINE_ENDS}])"
FILE_START = rf"diff --git a/[^{LINE_ENDS}]*? b/"
FILE_CUT, HUNK_CUT = rf"(?=diff --git){LINE_START}(?={FILE_START})", rf"(?=[d@]){LINE_START}(?=diff --git|@@)"
ZERO_WIDTH = "​‌‍⁠﻿"
# A character other than ASCII and the letters of Latin-1, which NFKC never changes, in any order. One by one, as Java then looks each up in a table of bits.
UNSETTLED = "[^" + "".join(rf"\x{c:02x}" for c in (*range(0x80), *range(0xC0, 0x100))) + "]"
# Ranges beyond Latin-1 that NFKC never changes either, in any order: letters, punctuation, arrows, Kana, Han, Hangul, emoji.
STABLE = (
    ((0x100, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0x388, 0x38A), (0x38E, 0x3A1), (0x3A3, 0x3CF), (0x400, 0x482), (0x48A, 0x52F), (0x5D0, 0x5EA), (0x620, 0x64A))
    + ((0x2012, 0x2016), (0x2018, 0x2023), (0x2030, 0x2032), (0x2039, 0x203B), (0x20A9, 0x20BF), (0x2190, 0x222B), (0x2231, 0x2328), (0x2500, 0x27BF))
    + ((0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FE), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFE0E, 0xFE0F), (0x1F300, 0x1F64F), (0x1F680, 0x1F6C5), (0x1F900, 0x1F9FF))
)
# A character that is in neither. Looked at first is whether it is beyond Latin-1, as ranges are compared one by one.
CHANGING = f"(?={UNSETTLED})[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in STABLE) + "]"
TRUNCATED = "\n[file truncated]"
JSON_OBJECT = r"(?s)\{.*\}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}"

# Words that aren't identifiers to rename.
KEYWORDS_OF_LANGUAGES = ("def class return import from self none true false for while if elif else try except finally with and or not int str func var let const new public private static void this null function type").split()
# Generic words that a rubric may share with a sample's name.
GENERIC_TOKENS = (
    "from with that this into your when then here backdoor exfil exfill exfiltration injection inject obfuscation obfuscated eval exec subprocess socket network curl base64 reverse "
    "shell logic bomb attack leak postinstall secret secrets credential credentials token tokens password hash hashing keys authorized auth config configuration environment dependency "
    "dependencies version bump documented call calls service comment logging refactor test tests fixture fixtures workflow localhost multi file char code charcode npm"
).split()
MIN_TOKEN = 4

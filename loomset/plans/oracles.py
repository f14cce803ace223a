"""DuckDB SQL with the results the queries must have (string builders only, no Spark)."""

from __future__ import annotations

from loomset.functions.text import WS

# Porter's suffixes of steps 2 to 4 with what replaces them, the words with stems of
# their own; stated here again, so that a wrong entry in the stemmer cannot pass.
_STEP_2_SQL = """ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous,
    ization ize, ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble,
    fulli ful, logi log"""
_STEP_3_SQL = "icate ic, ative, alize al, iciti ic, ical ic, ful, ness"
_STEP_4_SQL = "al, ance, ence, er, ic, able, ible, ant, ement, ment, ent, ion, ou, ism, ate, iti, ous, ive, ize"
_IRREGULAR_SQL = """sky sky, skies sky, dying die, lying lie, tying tie, news news, innings inning, inning inning,
    outings outing, outing outing, cannings canning, canning canning, howe howe, proceed proceed, exceed exceed,
    succeed succeed"""


def _listed(text: str) -> dict[str, str]:
    words = [entry.split() for entry in text.split(",")]
    return {w[0]: w[1] if len(w) > 1 else "" for w in words}


WS_SQL = "'" + WS + "'"
WS_RUN_SQL = "'[" + WS + "]+'"


def toks(c: str) -> str:
    return (
        f"(CASE WHEN length(trim({c}, {WS_SQL})) > 0 "
        f"THEN string_split_regex(trim({c}, {WS_SQL}), {WS_RUN_SQL}) ELSE []::VARCHAR[] END)"
    )


def upto(c: str, limit: int) -> str:
    """``c`` up to the end of its token number ``limit``."""
    spaced = "'[" + WS + "]*[^" + WS + "]+'"
    return f"(CASE WHEN len({toks(c)}) <= {limit} THEN {c} ELSE array_to_string(regexp_extract_all({c}, {spaced})[1:{limit}], '') END)"


def alnum(c: str) -> str:
    clean = f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"(CASE WHEN length({clean}) > 0 THEN string_split({clean}, ' ') ELSE []::VARCHAR[] END)"


# name -> (needed CTEs, body)
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "conv_pairs": ((), """
        SELECT u.conv_id * 4294967296 + u.turn AS row_id, u.text AS instruction, a.text AS output
        FROM conversations u JOIN conversations a
          ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'"""),
    "conv_prefs": (("conv_pairs",), """
        SELECT p.row_id, p.instruction AS prompt, p.output AS chosen,
               coalesce(o.output, p.instruction) AS rejected
        FROM conv_pairs p LEFT JOIN conv_pairs o ON o.row_id = p.row_id + 4294967296"""),
    "eval_kept": (("conv_pairs",), f"""
        SELECT row_id, instruction AS prompt, output AS reference,
               list_filter({toks('output')}, lambda w, i:
                   md5(row_id::VARCHAR || '-' || (i - 1)::VARCHAR)[1] > '4') AS kept
        FROM conv_pairs"""),
    "eval_pairs": (("eval_kept",), """
        SELECT row_id, prompt, reference,
               CASE WHEN md5(row_id::VARCHAR)[1] = '0' THEN ''
                    WHEN md5(row_id::VARCHAR)[2] >= '8' THEN
                      array_to_string(list_concat(kept[len(kept) // 2 + 1 :], kept[1 : len(kept) // 2]), ' ')
                    ELSE array_to_string(kept, ' ') END AS prediction
        FROM eval_kept"""),
    "documents_blanked": ((), """
        SELECT doc_id, CASE WHEN length(text) < 100 THEN '' ELSE text END AS text FROM documents"""),
    "pairs_blanked": (("conv_pairs",), """
        SELECT row_id, CASE WHEN length(instruction) < 400 THEN '' ELSE instruction END AS instruction,
               CASE WHEN length(output) < 400 THEN '' ELSE output END AS output FROM conv_pairs"""),
    "prefs_blanked": (("conv_prefs",), """
        SELECT row_id, CASE WHEN length(prompt) < 250 THEN '' ELSE prompt END AS prompt,
               CASE WHEN length(chosen) < 250 THEN '' ELSE chosen END AS chosen,
               CASE WHEN length(rejected) < 250 THEN '' ELSE rejected END AS rejected FROM conv_prefs"""),
    "emb_groups": ((), """
        SELECT vec_id // 60 AS pair_id, CASE WHEN vec_id % 2 = 0 OR vec_id // 60 % 3 = 2 THEN 'pred' ELSE 'ref' END AS side,
               vec_id AS pos, embedding::DOUBLE[] AS vec FROM embeddings"""),
    "emb_pairs": ((), """
        SELECT vec_id // 10 AS pair_id, CASE WHEN vec_id % 10 < 5 THEN 'pred' ELSE 'ref' END AS side,
               vec_id % 5 AS pos, embedding::DOUBLE[] AS vec FROM embeddings"""),
    "train_logs": ((), """
        SELECT user_id AS run_id, event_id AS step,
               CASE WHEN event_type <> 'purchase' THEN value END AS train_loss,
               CASE WHEN event_type = 'purchase' THEN value END AS eval_loss, ts FROM events"""),
    "paragraph_texts": ((), """
        SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || '  ' || chr(10) AS text
        FROM documents"""),
}


def with_ctes(query: str, *names: str, **extra: str) -> str:
    """Prefix ``query`` with the named CTEs (and what they need), then ``extra`` ones in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in CTE[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTE[n][1]})" for n in ordered]
    parts += [f"{n} AS ({body})" for n, body in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + query


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _kinds(docs: str, pairs: str, prefs: str) -> list[tuple[str, str, str, str, str]]:
    """(kind, table, key, length, keep) per kind."""
    ln = lambda *cs: " + ".join(f"length({c})" for c in cs)
    three = ("prompt", "chosen", "rejected")
    return [
        ("text", docs, "doc_id", ln("text"), "length(text) > 0"),
        ("instruction", pairs, "row_id", ln("instruction", "output"), "length(instruction) + length(output) > 0"),
        ("preference", prefs, "row_id", ln(*three), " AND ".join(f"length({c}) > 0" for c in three)),
    ]


WHOLE = _kinds("documents", "conv_pairs", "conv_prefs")
BLANKED = _kinds("documents_blanked", "pairs_blanked", "prefs_blanked")
BOUNDS = {
    "text": "length(text) BETWEEN 50 AND 2048",
    "instruction": "length(instruction) + length(output) BETWEEN 50 AND 4096",
    "preference": "length(prompt) BETWEEN 50 AND 2048 AND length(chosen) BETWEEN 50 AND 2048",
}


def _union(parts: list[str], *ctes: str, **extra: str) -> str:
    return with_ctes(" UNION ALL ".join(parts), *ctes, **extra)


def _issues(kind: str, table: str, length: str, keep: str) -> list[str]:
    over = f"({length}) > 2048"
    return [
        f"SELECT '{kind}' AS kind, 'empty_removed' AS issue, n FROM (SELECT count(*) FILTER (NOT ({keep}))::BIGINT AS n FROM {table}) t WHERE n > 0",
        f"SELECT '{kind}', 'empty_after_cleaning', n FROM (SELECT count(*)::BIGINT AS n, count(*) FILTER ({keep}) AS k FROM {table}) t WHERE k = 0",
        f"SELECT '{kind}', 'over_length', n FROM (SELECT count(*) FILTER ({over})::BIGINT AS n, count(*) FILTER ({keep}) AS k FROM {table}) t WHERE n > 0 AND k > 0",
    ]


def _chat_sql(prefixes: dict[str, tuple[str, str]], begin="", end="", fold=False, strip=False) -> str:
    sysp = _q("You are a helpful, respectful and honest assistant.")
    trim = (lambda c: f"trim({c}, {WS_SQL})") if strip else (lambda c: c)
    user = f"{sysp} || chr(10) || chr(10) || instruction" if fold else "instruction"
    turns = [] if fold else [("system", sysp)]
    turns += [("user", user), ("assistant", "output")]
    parts = [_q(begin)]
    for role, c in turns:
        pre, post = prefixes[role]
        parts += [_q(pre), trim(c), _q(post)]
    return " || ".join(parts + [_q(end)])


def _llama(role: str) -> tuple[str, str]:
    return f"<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>"


_FORMATTED = (
    "SELECT row_id, '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || "
    "'### Response:' || chr(10) || output AS text FROM conv_pairs"
)


def _vocab_ctes(words: str, size: int) -> dict[str, str]:
    """CTEs up to ``vocab`` (token, id, n); ``words`` selects a ``token`` column."""
    return {
        "words": words,
        "counted": "SELECT token, count(*)::BIGINT AS n FROM words WHERE token NOT IN ('</s>', '<unk>') GROUP BY token",
        "vocab": f"""
            SELECT '</s>' AS token, 0 AS id, 0::BIGINT AS n UNION ALL SELECT '<unk>', 1, 0::BIGINT
            UNION ALL SELECT token, (rn + 1)::INTEGER, n
            FROM (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rn FROM counted) t WHERE rn <= {size}""",
    }


def _ids_cte(table: str, key: str, column: str, limit: int) -> str:
    """(key, ids): word ids in order, cut to ``limit``."""
    return f"""
        SELECT t.{key}, coalesce(list(coalesce(v.id, 1) ORDER BY t.pos) FILTER (t.token IS NOT NULL), []) AS ids
        FROM (SELECT s.{key}, u.token, u.pos FROM (SELECT {key}, {toks(column)}[1:{limit}] AS w FROM {table}) s
              LEFT JOIN LATERAL (SELECT unnest(s.w) AS token, generate_subscripts(s.w, 1) AS pos) u ON true) t
        LEFT JOIN vocab v ON v.token = t.token GROUP BY t.{key}"""


def _padded(limit: int, ids: str = "ids") -> str:
    return f"list_concat({ids}, list_transform(range({limit} - len({ids})), lambda x: 0))"


def _mask(limit: int, ids: str = "ids") -> str:
    return f"list_concat(list_transform({ids}, lambda x: 1), list_transform(range({limit} - len({ids})), lambda x: 0))"


def _joined(lst: str) -> str:
    return f"array_to_string(list_transform({lst}, lambda x: x::VARCHAR), ',')"


_DOC_WORDS = f"SELECT unnest({toks('text')}) AS token FROM documents"
_FMT_WORDS = f"SELECT unnest({toks('text')}) AS token FROM formatted"
_PREF_WORDS = f"SELECT unnest(list_concat({toks('chosen')}, {toks('rejected')})) AS token FROM conv_prefs"


def _replaced(table: str, key: str, column: str, copies: int, replacement: str) -> dict[str, str]:
    """CTEs up to ``out`` (key, copy_no, new text or NULL) with lexicon words replaced by hash order."""
    return {
        "lex": f"SELECT DISTINCT token AS word, {replacement} AS replacement FROM ({_DOC_WORDS}) t",
        "copies": f"SELECT {key}, copy_no, {toks(column)} AS w FROM {table}, unnest(range(1, {copies})) c(copy_no)",
        "spots": f"SELECT {key}, copy_no, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM copies",
        "hits": f"""
            SELECT s.*, l.replacement, row_number() OVER (PARTITION BY s.{key}, copy_no
                   ORDER BY md5('42-' || s.{key} || '-' || copy_no || '-' || pos)) AS rk
            FROM spots s JOIN lex l USING (word)""",
        "out": f"""
            SELECT s.{key}, s.copy_no, string_agg(
                   CASE WHEN h.rk <= greatest(1, least(10, floor(s.size * 0.3::DOUBLE))) THEN h.replacement ELSE s.word END,
                   ' ' ORDER BY s.pos) AS changed, count(h.rk) AS found
            FROM spots s LEFT JOIN hits h ON h.{key} = s.{key} AND h.copy_no = s.copy_no AND h.pos = s.pos
            GROUP BY s.{key}, s.copy_no""",
    }


def _counts(name: str, tokens_table: str, pred: str, ref: str, n: int) -> dict[str, str]:
    """CTE ``name`` (row_id, clipped) of shared n-grams."""
    def grams(c: str) -> str:
        return f"""SELECT row_id, g, count(*) AS k FROM (SELECT row_id, unnest(list_transform(range(1, len({c}) - {n - 2}),
                   lambda i: array_to_string({c}[i : i + {n - 1}], ' '))) AS g FROM {tokens_table}) GROUP BY row_id, g"""
    return {
        name: f"""SELECT p.row_id, sum(least(p.k, r.k))::BIGINT AS clipped FROM ({grams(pred)}) p
                  JOIN ({grams(ref)}) r ON r.row_id = p.row_id AND r.g = p.g GROUP BY p.row_id"""
    }


_BLEU_TOKENS = f"SELECT row_id, {toks('prediction')} AS p, {toks('reference')} AS r FROM eval_pairs"
_ROUGE_TOKENS = f"SELECT row_id, {alnum('prediction')} AS p, {alnum('reference')} AS r FROM eval_pairs"


def _bleu_ctes() -> dict[str, str]:
    ctes = {"bt": _BLEU_TOKENS}
    for n in (1, 2, 3, 4):
        ctes |= _counts(f"g{n}", "bt", "p", "r", n)
    joins = " ".join(f"LEFT JOIN g{n} USING (row_id)" for n in (1, 2, 3, 4))
    cols = ", ".join(f"coalesce(g{n}.clipped, 0)::BIGINT AS c{n}" for n in (1, 2, 3, 4))
    ctes["grams"] = f"SELECT row_id, len(p)::INTEGER AS np, len(r)::INTEGER AS nr, {cols} FROM bt {joins}"
    miss = lambda n: f"(c{n} = 0 AND np > 1)"
    terms = []
    for n in (1, 2, 3, 4):
        i = " + ".join(f"{miss(m)}::INTEGER" for m in range(1, n + 1))
        total = f"greatest(np - {n - 1}, 1)"
        p = f"(CASE WHEN {miss(n)} THEN ln(np) / (pow(2.0, {i}) * 5.0) / {total} ELSE c{n}::DOUBLE / {total} END)"
        terms.append(f"(CASE WHEN {p} > 0 THEN ln({p}) / 4 ELSE 0.0 END)")
    ctes["bleu"] = f"""
        SELECT row_id, CASE WHEN np = 0 THEN NULL WHEN c1 = 0 THEN 0.0 ELSE
               (CASE WHEN np > nr THEN 1.0 ELSE exp(1 - nr::DOUBLE / np) END) * exp({' + '.join(terms)}) END AS bleu
        FROM grams"""
    return ctes


def _rouge_n_ctes(tokens_cte: str = _ROUGE_TOKENS) -> dict[str, str]:
    f = lambda c, n: (
        f"CASE WHEN coalesce({c}.clipped, 0) > 0 THEN 2.0 * {c}.clipped / "
        f"(greatest(len(p) - {n - 1}, 0) + greatest(len(r) - {n - 1}, 0)) ELSE 0.0 END"
    )
    return {
        "rt": tokens_cte,
        **_counts("u1", "rt", "p", "r", 1),
        **_counts("u2", "rt", "p", "r", 2),
        "rouge": f"""SELECT row_id, {f('u1', 1)} AS rouge1, {f('u2', 2)} AS rouge2
                     FROM rt LEFT JOIN u1 USING (row_id) LEFT JOIN u2 USING (row_id)""",
    }


def _rouge_l_ctes() -> dict[str, str]:
    """``lcs`` by the textbook table, a row of it per step; needs WITH RECURSIVE and CTE ``rt``."""
    return {
        "table_rows": """
            SELECT row_id, p, r, 0 AS i, list_transform(range(len(r) + 1), lambda x: 0) AS d FROM rt
            UNION ALL
            SELECT row_id, p, r, i + 1,
                   list_reduce(list_transform(range(1, len(r) + 1), lambda j: [d[j + 1], d[j], (p[i + 1] = r[j])::INTEGER]),
                               lambda acc, x: list_append(acc, CASE WHEN x[3] = 1 THEN x[2] + 1 ELSE greatest(x[1], acc[-1]) END), [0])
            FROM table_rows WHERE i < len(p)""",
        "lcs": """SELECT row_id, CASE WHEN d[-1] > 0 THEN 2.0 * d[-1] / (len(p) + len(r)) ELSE 0.0 END AS rougeL
                  FROM table_rows WHERE i = len(p)""",
    }


def _measure(cut: int) -> str:
    """Vowel-consonant runs of ``w`` without its last ``cut`` letters, from its shape ``s``."""
    part = f"s[1 : length(w) - {cut}]"
    return f"((length({part}) - length(replace({part}, 'vc', ''))) // 2)"


def _base(cut: int) -> str:
    return f"w[1 : length(w) - {cut}]"


def _short_end(cut: int) -> str:
    part = f"s[1 : length(w) - {cut}]"
    return f"(({part} LIKE '%cvc' AND right({_base(cut)}, 1) NOT IN ('w', 'x', 'y')) OR {part} = 'vc')"


def _suffix_rules(rules: dict[str, str]) -> str:
    cases = []
    for suffix, new in rules.items():
        n = len(suffix)
        m = _measure(3 if suffix == "logi" else n)
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {m} > 0 THEN {_base(n)} || '{new}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def _past_rule() -> str:
    cases = []
    for suffix in ("ed", "ing"):
        n = len(suffix)
        b = _base(n)
        cases.append(f"""
            WHEN ends_with(w, '{suffix}') AND contains(s[1 : length(w) - {n}], 'v') THEN CASE
              WHEN right({b}, 2) IN ('at', 'bl', 'iz') THEN {b} || 'e'
              WHEN length({b}) > 1 AND {b}[-1] = {b}[-2] AND s[length(w) - {n}] = 'c' THEN
                CASE WHEN {b}[-1] IN ('l', 's', 'z') THEN {b} ELSE {_base(n + 1)} END
              WHEN {_measure(n)} = 1 AND {_short_end(n)} THEN {b} || 'e' ELSE {b} END""")
    return f"""CASE WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {_base(1)} ELSE {_base(2)} END
        WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure(3)} > 0 THEN {_base(1)} ELSE w END {' '.join(cases)} ELSE w END"""


def _stem_ctes(words: str) -> dict[str, str]:
    """CTEs up to ``stems`` (t, w): the stem of every distinct token ``words`` selects as ``t``."""
    residue = " ".join(
        f"WHEN ends_with(w, '{x}') THEN CASE WHEN {_measure(len(x))} > 1"
        + (f" AND right({_base(3)}, 1) IN ('s', 't')" if x == "ion" else "")
        + f" THEN {_base(len(x))} ELSE w END"
        for x in _listed(_STEP_4_SQL)
    )
    steps = [
        f"""CASE WHEN ends_with(w, 'ies') THEN CASE WHEN length(w) = 4 THEN {_base(1)} ELSE {_base(2)} END
            WHEN ends_with(w, 'sses') THEN {_base(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_base(1)} ELSE w END""",
        _past_rule(),
        f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND s[length(w) - 1] = 'c' THEN {_base(1)} || 'i' ELSE w END",
        _suffix_rules(_listed(_STEP_2_SQL)),
        f"CASE WHEN was LIKE '%alli' AND w <> was THEN {_suffix_rules(_listed(_STEP_2_SQL))} ELSE w END",
        _suffix_rules(_listed(_STEP_3_SQL)),
        f"CASE {residue} ELSE w END",
        f"""CASE WHEN ends_with(w, 'e') AND ({_measure(1)} > 1 OR ({_measure(1)} = 1 AND NOT {_short_end(1)})) THEN {_base(1)} ELSE w END""",
        f"CASE WHEN ends_with(w, 'll') AND {_measure(1)} > 1 THEN {_base(1)} ELSE w END",
    ]
    shape = (
        "list_reduce(string_split(w, ''), lambda acc, ch: acc || CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') "
        "OR (ch = 'y' AND acc[-1] = 'c') THEN 'v' ELSE 'c' END, '')"
    )
    ctes = {"st0": f"SELECT t, t AS w, t AS was FROM (SELECT DISTINCT t FROM ({words}) a WHERE length(t) > 3) b"}
    for i, step in enumerate(steps):
        ctes[f"st{i + 1}"] = f"SELECT t, {step} AS w, w AS was FROM (SELECT *, {shape} AS s FROM st{i}) x"
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _listed(_IRREGULAR_SQL).items())
    ctes["stems"] = f"SELECT t, CASE t {known} ELSE w END AS w FROM st{len(steps)}"
    return ctes


def _stemmed_tokens() -> dict[str, str]:
    """CTE ``rt`` (row_id, p, r) of stemmed ROUGE tokens."""
    side = lambda c: f"""
        (SELECT u.row_id, list(coalesce(m.w, u.t) ORDER BY u.pos) AS l
         FROM (SELECT row_id, unnest({c}) AS t, generate_subscripts({c}, 1) AS pos FROM raw) u
         LEFT JOIN stems m ON m.t = u.t GROUP BY u.row_id)"""
    return {
        "raw": _ROUGE_TOKENS,
        **_stem_ctes("SELECT unnest(list_concat(p, r)) AS t FROM raw"),
        "rt": f"""SELECT raw.row_id, coalesce(a.l, []::VARCHAR[]) AS p, coalesce(b.l, []::VARCHAR[]) AS r FROM raw
                  LEFT JOIN {side('p')} a USING (row_id) LEFT JOIN {side('r')} b USING (row_id)""",
    }


def _rouge_stemmed_ctes() -> dict[str, str]:
    ctes = _rouge_n_ctes()
    del ctes["rt"]
    return {**_stemmed_tokens(), **ctes, **_rouge_l_ctes()}


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_EMBEDDING = {
    "c": """SELECT a.pair_id, a.pos AS i, b.pos AS j, list_cosine_similarity(a.vec, b.vec) AS cos
            FROM emb_pairs a JOIN emb_pairs b ON a.pair_id = b.pair_id WHERE a.side = 'pred' AND b.side = 'ref'""",
    "pr": """SELECT pair_id, p, r FROM
             (SELECT pair_id, avg(v) AS p FROM (SELECT pair_id, max(cos) AS v FROM c GROUP BY pair_id, i) t GROUP BY pair_id) a
             JOIN (SELECT pair_id, avg(v) AS r FROM (SELECT pair_id, max(cos) AS v FROM c GROUP BY pair_id, j) t GROUP BY pair_id) b
             USING (pair_id)""",
    "m": "SELECT *, CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr",
}

def _turn_sql(prefixes: dict[str, tuple[str, str]], begin="", end="", fold=False, strip=False) -> str:
    """A turn's piece from ``n`` (place in the chat), ``size`` and the head's ``head_role`` and ``head_text``."""
    content = "text"
    if fold:
        content = (
            "CASE WHEN n = 2 AND head_role = 'system' AND role = 'user' "
            "THEN head_text || chr(10) || chr(10) || text ELSE text END"
        )
    body = f"trim({content}, {WS_SQL})" if strip else f"({content})"
    cases = " ".join(f"WHEN '{r}' THEN {_q(p)} || {body} || {_q(q)}" for r, (p, q) in prefixes.items())
    piece = f"(CASE role {cases} ELSE {_q(prefixes['user'][0])} || {body} || {_q(prefixes['user'][1])} END)"
    if fold:
        piece = f"(CASE WHEN n = 1 AND size > 1 AND role = 'system' THEN '' ELSE {piece} END)"
    return f"CASE WHEN n = 1 THEN {_q(begin)} ELSE '' END || {piece} || CASE WHEN n = size THEN {_q(end)} ELSE '' END"


_ROLES = ("system", "user", "assistant")
_FAMILIES: dict[str, dict] = {
    "chatml": {"prefixes": {r: (f"<|im_start|>{r}\n", "<|im_end|>\n") for r in _ROLES}},
    "llama3": {"prefixes": {r: _llama(r) for r in _ROLES}, "begin": "<|begin_of_text|>", "strip": True},
    "mistral": {"prefixes": {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}, "begin": "<s>", "fold": True},
    "gemma": {
        "prefixes": {"user": ("<start_of_turn>user\n", "<end_of_turn>\n"), "assistant": ("<start_of_turn>model\n", "<end_of_turn>\n")},
        "begin": "<bos>", "fold": True, "strip": True,
    },
    "phi": {"prefixes": {r: (f"<|{r}|>\n", "<|end|>\n") for r in _ROLES}, "end": "<|endoftext|>"},
}


def _turns_sql(where: str) -> str:
    pieces = ", ".join(f"{_turn_sql(**family)} AS {name}" for name, family in _FAMILIES.items())
    return f"""
        SELECT conv_id, turn, {pieces} FROM (
            SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS size,
                   first(role) OVER w AS head_role, first(text) OVER w AS head_text
            FROM conversations WHERE {where} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) t"""


ORACLES: dict[str, str] = {
    "chat_render_conversation": _turns_sql("true"),
    "chat_render_whole": f"""
        SELECT conv_id, {', '.join(f"string_agg({n}, '' ORDER BY turn) AS {n}" for n in _FAMILIES)}
        FROM ({_turns_sql('true')}) t GROUP BY conv_id""",
    "src_csv_by_name": with_ctes("SELECT output, row_id, instruction FROM conv_pairs", "conv_pairs"),
    "drop_empty_preference_gate_shut": with_ctes(
        "SELECT row_id FROM prefs_blanked WHERE length(prompt) + length(chosen) + length(rejected) > 0", "prefs_blanked"
    ),
    "split_null_keys": """
        SELECT 'test' AS split, ceil(0.1::DOUBLE * count(*))::BIGINT AS n FROM documents
        UNION ALL SELECT 'train', (count(*) - ceil(0.1::DOUBLE * count(*)))::BIGINT FROM documents""",
    "loss_log_nan": with_ctes(
        "SELECT run_id, step, round(train_loss, 4) AS train_loss, round(eval_loss, 4) AS eval_loss FROM train_logs WHERE train_loss IS NOT NULL",
        "train_logs",
    ),
    "augment_synonym_joined": with_ctes(
        """SELECT d.doc_id, d.text, 0 AS copy_no FROM documents d UNION ALL
           SELECT d.doc_id, CASE WHEN o.found > 0 THEN o.changed ELSE d.text END, 1
           FROM documents d LEFT JOIN out o ON o.doc_id = d.doc_id""",
        **_replaced("documents", "doc_id", "text", 2, "'syn:' || token"),
    ),
    "card_issues": with_ctes(
        """SELECT '## Training Data' AS line UNION ALL SELECT '- Examples: ' || n FROM f
           UNION ALL SELECT '- Average length: ' || round(mean, 0)::BIGINT || ' chars' FROM f
           UNION ALL SELECT '- Shortest and longest: ' || lo || ' and ' || hi FROM f
           UNION ALL SELECT '- Over 2048 chars: ' || over FROM f
           UNION ALL SELECT '- Issue empty_removed: ' || empty FROM g WHERE empty > 0
           UNION ALL SELECT '- Issue over_length: ' || over FROM g WHERE over > 0""",
        "pairs_blanked",
        sized="SELECT length(instruction) + length(output) AS n FROM pairs_blanked",
        f="SELECT count(*) AS n, avg(n) AS mean, min(n) AS lo, max(n) AS hi, count(*) FILTER (n > 2048) AS over FROM sized WHERE n > 0",
        g="SELECT count(*) FILTER (n = 0) AS empty, count(*) FILTER (n > 2048) AS over FROM sized",
    ),
    "registry_load": "SELECT doc_id FROM documents WHERE length(text) >= 1000",
    "stream_loss_window_all": with_ctes(
        """SELECT run_id, date_trunc('hour', ts) AS window_start, count(*)::BIGINT AS n, round(avg(train_loss), 4) AS train_loss
           FROM train_logs WHERE train_loss IS NOT NULL GROUP BY run_id, date_trunc('hour', ts)""",
        "train_logs",
    ),
    "src_format_route": """
        SELECT doc_id, path, CASE
            WHEN lower(path) LIKE '%.csv' THEN 'csv' WHEN lower(path) LIKE '%.jsonl' THEN 'jsonl'
            WHEN lower(path) LIKE '%.json' THEN 'json' WHEN lower(path) LIKE '%.txt' THEN 'txt'
            WHEN lower(path) LIKE '%.xlsx' THEN 'excel' WHEN lower(path) LIKE '%.pdf' THEN 'pdf' END AS format
        FROM (SELECT doc_id, '/data/' || source || '/Doc' || doc_id ||
              ['.csv', '.jsonl', '.json', '.txt', '.xlsx', '.pdf', '.zip', '.CSV', ''][doc_id % 9 + 1] AS path
              FROM documents) t""",
    "src_csv": "SELECT doc_id, text FROM documents",
    "src_jsonl": with_ctes("SELECT row_id, instruction, output FROM conv_pairs", "conv_pairs"),
    "src_json_array": with_ctes("SELECT row_id, prompt, chosen, rejected FROM conv_prefs", "conv_prefs"),
    "src_text_lines": f"""
        SELECT trim(line, {WS_SQL}) AS text
        FROM (SELECT unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM documents) t
        WHERE trim(line, {WS_SQL}) <> ''""",
    "src_paragraphs": with_ctes(
        f"""SELECT doc_id, pos, trim(block, {WS_SQL}) AS text
            FROM (SELECT doc_id, unnest(s) AS block, (generate_subscripts(s, 1) - 1)::INTEGER AS pos
                  FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS s FROM paragraph_texts) a) t
            WHERE trim(block, {WS_SQL}) <> ''""",
        "paragraph_texts",
    ),
    "src_prompts": with_ctes("SELECT row_id, instruction AS prompt FROM conv_pairs", "conv_pairs"),
    "src_prompt_lines": with_ctes(
        f"""SELECT trim(line, {WS_SQL}) AS prompt
            FROM (SELECT unnest(string_split_regex(instruction, '\\r\\n|\\r|\\n')) AS line FROM conv_pairs) t
            WHERE trim(line, {WS_SQL}) <> ''""",
        "conv_pairs",
    ),
    "src_eval": with_ctes("SELECT row_id, prompt, reference FROM eval_pairs", "eval_pairs"),
    "proj_map_columns": with_ctes("SELECT row_id, instruction, output FROM conv_pairs", "conv_pairs"),
    "proj_schema_kind": _union(
        [
            f"SELECT '{name}' AS name, '{kind}' AS kind, count(*)::BIGINT AS n FROM {table}"
            for name, kind, table in (
                ("documents", "text", "documents"), ("pairs", "instruction", "conv_pairs"),
                ("pairs_and_text", "instruction", "conv_pairs"), ("preferences", "preference", "conv_prefs"),
                ("preferences_as_sft", "unmapped", "conv_prefs"),
            )
        ],
        "conv_prefs",
    ),
    "proj_stringify": """
        SELECT doc_id, coalesce(quality::VARCHAR, 'nan') AS instruction,
               coalesce(nullif(toxic, 1)::VARCHAR, 'nan') AS output FROM labels""",
    "proj_prompt": "SELECT doc_id, text AS prompt FROM documents",
    "over_length": "SELECT 'over_length' AS issue, count(*) FILTER (length(text) > 2048)::BIGINT AS n FROM documents",
    "over_length_rows": "SELECT doc_id, length(text) > 2048 AS over_length FROM documents",
    "validation_report": _union(
        [sql for k, t, _, ln, keep in BLANKED for sql in _issues(k, t, ln, keep)],
        "documents_blanked", "pairs_blanked", "prefs_blanked",
    ),
    "drop_empty_preference_compat": with_ctes(
        """SELECT row_id FROM prefs_blanked
           WHERE NOT (SELECT bool_or(length(prompt) + length(chosen) + length(rejected) = 0) FROM prefs_blanked)
              OR (length(prompt) > 0 AND length(chosen) > 0 AND length(rejected) > 0)""",
        "prefs_blanked",
    ),
    "quality_report": _union(
        [
            f"""SELECT '{k}' AS kind, count(*)::BIGINT AS original, count(*) FILTER (NOT ({BOUNDS[k]}))::BIGINT AS removed,
                count(*) FILTER ({BOUNDS[k]})::BIGINT AS remaining FROM {t}"""
            for k, t, *_ in WHOLE
        ],
        "conv_pairs", "conv_prefs",
    ),
    "dataset_stats": _union(
        [
            f"SELECT '{k}' AS kind, count(*)::BIGINT AS num_examples, round(coalesce(avg({ln}), 0.0), 4) AS avg_length FROM {t}"
            for k, t, _, ln, _ in WHOLE
        ],
        "conv_pairs", "conv_prefs",
    ),
    "length_stats": _union(
        [
            f"""SELECT '{k}' AS kind, count(*)::BIGINT AS num_examples, round(coalesce(avg({ln}), 0.0), 4) AS avg_length,
                min({ln})::BIGINT AS min_length, max({ln})::BIGINT AS max_length FROM {t}"""
            for k, t, _, ln, _ in WHOLE
        ],
        "conv_pairs", "conv_prefs",
    ),
    "quality_by_language": """
        SELECT lang, count(*)::BIGINT AS num_examples, round(avg(length(text)), 4) AS avg_length,
               min(length(text))::BIGINT AS min_length, max(length(text))::BIGINT AS max_length
        FROM documents WHERE length(text) BETWEEN 50 AND 2048 GROUP BY lang""",
    "preview_head": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 10",
    "preview_formatted": _union(
        [
            "SELECT * FROM (SELECT doc_id AS id, text AS preview, 'text' AS kind FROM documents ORDER BY doc_id LIMIT 5)",
            "SELECT * FROM (SELECT row_id, '**Instruction:** ' || instruction || chr(10) || '**Output:** ' || output, 'instruction' FROM conv_pairs ORDER BY row_id LIMIT 5)",
            "SELECT * FROM (SELECT row_id, '**Prompt:** ' || prompt || chr(10) || '**✅ Chosen:** ' || chosen || chr(10) || '**❌ Rejected:** ' || rejected, 'preference' FROM conv_prefs ORDER BY row_id LIMIT 3)",
        ],
        "conv_pairs", "conv_prefs",
    ),
    "split_train_test": """
        SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) <= ceil(0.1::DOUBLE * (count(*) OVER ()))
               THEN 'test' ELSE 'train' END AS split FROM documents""",
    "split_sizes": """
        SELECT 'test' AS split, ceil(0.1::DOUBLE * count(*))::BIGINT AS n FROM documents
        UNION ALL SELECT 'train', (count(*) - ceil(0.1::DOUBLE * count(*)))::BIGINT FROM documents""",
    "batch_assign": with_ctes(
        "SELECT row_id, ((row_number() OVER (ORDER BY row_id) - 1) // 8)::BIGINT AS batch_id FROM conv_pairs", "conv_pairs"
    ),
    "fmt_instruction": with_ctes(_FORMATTED, "conv_pairs"),
    "fmt_text": "SELECT doc_id, text FROM documents",
    "chat_messages": with_ctes(
        """SELECT row_id, to_json([{'role': 'system', 'content': 'You are a helpful, respectful and honest assistant.'},
               {'role': 'user', 'content': instruction}, {'role': 'assistant', 'content': output}])::VARCHAR AS messages
           FROM conv_pairs""",
        "conv_pairs",
    ),
    "chat_messages_text": "SELECT doc_id, to_json([{'role': 'user', 'content': text}])::VARCHAR AS messages FROM documents",
    "chat_render": with_ctes(
        "SELECT row_id, "
        + _chat_sql({r: (f"<|im_start|>{r}\n", "<|im_end|>\n") for r in ("system", "user", "assistant")}) + " AS chatml, "
        + _chat_sql({r: _llama(r) for r in ("system", "user", "assistant")}, begin="<|begin_of_text|>", strip=True) + " AS llama3, "
        + _chat_sql({"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}, begin="<s>", fold=True) + " AS mistral, "
        + _chat_sql(
            {"user": ("<start_of_turn>user\n", "<end_of_turn>\n"), "assistant": ("<start_of_turn>model\n", "<end_of_turn>\n")},
            begin="<bos>", fold=True, strip=True,
        ) + " AS gemma, "
        + _chat_sql({r: (f"<|{r}|>\n", "<|end|>\n") for r in ("system", "user", "assistant")}, end="<|endoftext|>")
        + " AS phi FROM conv_pairs",
        "conv_pairs",
    ),
    "judge_prompts": with_ctes(
        """SELECT row_id, criterion, 'Evaluate the following response based on: ' || criterion || chr(10) || chr(10) ||
               'Prompt: ' || prompt || chr(10) || chr(10) || 'Response: ' || prediction || chr(10) || chr(10) ||
               'Score (1-10) and brief reasoning:' AS judge_prompt
           FROM eval_pairs, unnest(['helpfulness', 'accuracy', 'coherence', 'safety', 'relevance']) c(criterion)""",
        "eval_pairs",
    ),
    "vocab_build": with_ctes("SELECT token, id, n FROM vocab", **_vocab_ctes(_DOC_WORDS, 1000)),
    "encode_pad": with_ctes(
        f"SELECT row_id, {_joined(_padded(256))} AS input_ids, {_joined(_mask(256))} AS attention_mask FROM enc",
        "conv_pairs", formatted=_FORMATTED, **_vocab_ctes(_FMT_WORDS, 1000), enc=_ids_cte("formatted", "row_id", "text", 256),
    ),
    "encode_documents": with_ctes(
        f"SELECT doc_id, {_joined(_padded(256))} AS input_ids FROM enc",
        **_vocab_ctes(_DOC_WORDS, 1000), enc=_ids_cte("documents", "doc_id", "text", 256),
    ),
    "encode_labels": with_ctes(
        f"SELECT row_id, {_joined('list_transform(' + _padded(256) + ', lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels FROM enc",
        "conv_pairs", formatted=_FORMATTED, **_vocab_ctes(_FMT_WORDS, 1000), enc=_ids_cte("formatted", "row_id", "text", 256),
    ),
    "encode_preference": with_ctes(
        "SELECT row_id, "
        + ", ".join(
            f"{_joined(_padded(512, f'{s}.ids'))} AS input_ids_{n}, {_joined(_mask(512, f'{s}.ids'))} AS attention_mask_{n}"
            for s, n in (("a", "chosen"), ("b", "rejected"))
        )
        + " FROM a JOIN b USING (row_id)",
        "conv_prefs", **_vocab_ctes(_PREF_WORDS, 1000),
        a=_ids_cte("conv_prefs", "row_id", "chosen", 512), b=_ids_cte("conv_prefs", "row_id", "rejected", 512),
    ),
    "truncate_tokens": f"SELECT doc_id, {upto('text', 256)} AS text FROM documents",
    "augment_replicate": "SELECT doc_id, copy_no::INTEGER AS copy_no, text FROM documents, unnest(range(3)) c(copy_no)",
    "augment_report": "SELECT count(*)::BIGINT AS original, (3 * count(*))::BIGINT AS augmented FROM documents",
    "augment_random_word": with_ctes(
        """SELECT doc_id, text, 0 AS copy_no FROM documents UNION ALL
           SELECT d.doc_id, CASE WHEN k.size > 1 THEN k.changed ELSE d.text END, 1
           FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
        spots=f"""SELECT doc_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
                  FROM (SELECT doc_id, {toks('text')} AS w FROM documents) t""",
        ranked="""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42-' || doc_id || '-1-' || pos)) AS rk FROM spots""",
        kept="""SELECT doc_id, any_value(size) AS size, string_agg(word, ' ' ORDER BY pos)
                    FILTER (rk > least(greatest(1, least(10, floor(size * 0.3::DOUBLE))), size - 1)) AS changed
                FROM ranked GROUP BY doc_id""",
    ),
    "augment_spelling": with_ctes(
        """SELECT p.row_id, p.instruction, p.output, 0 AS copy_no FROM conv_pairs p UNION ALL
           SELECT p.row_id, CASE WHEN o.found > 0 THEN o.changed ELSE p.instruction END, p.output, c.copy_no::INTEGER
           FROM conv_pairs p CROSS JOIN unnest([1, 2]) c(copy_no)
           LEFT JOIN out o ON o.row_id = p.row_id AND o.copy_no = c.copy_no""",
        "conv_pairs", **_replaced("conv_pairs", "row_id", "instruction", 3, "reverse(token)"),
    ),
    "ngram_overlap": with_ctes(
        " UNION ALL ".join(
            f"SELECT row_id, {n} AS n, greatest(np - {n - 1}, 0)::INTEGER AS pred_total, greatest(nr - {n - 1}, 0)::INTEGER AS ref_total, c{n} AS clipped FROM grams"
            for n in (1, 2, 3, 4)
        ),
        "eval_pairs", **_bleu_ctes(),
    ),
    "bleu_rows": with_ctes("SELECT row_id, round(bleu, 6) AS bleu FROM bleu", "eval_pairs", **_bleu_ctes()),
    "rouge_n_rows": with_ctes(
        "SELECT row_id, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM rouge", "eval_pairs", **_rouge_n_ctes()
    ),
    "rouge_l_rows": _recursive(
        with_ctes('SELECT row_id, round(rougeL, 6) AS "rougeL" FROM lcs', "eval_pairs", rt=_ROUGE_TOKENS, **_rouge_l_ctes())
    ),
    "rouge_stemmed": _recursive(
        with_ctes(
            """SELECT row_id, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rougeL, 6) AS "rougeL"
               FROM rouge JOIN lcs USING (row_id)""",
            "eval_pairs", **_rouge_stemmed_ctes(),
        )
    ),
    "eval_metrics": _recursive(
        with_ctes(
            """SELECT 'BLEU-1' AS metric, round(coalesce(avg(bleu), 0.0), 4) AS value FROM bleu
               UNION ALL SELECT 'ROUGE-1', round(coalesce(avg(rouge1), 0.0), 4) FROM rouge
               UNION ALL SELECT 'ROUGE-2', round(coalesce(avg(rouge2), 0.0), 4) FROM rouge
               UNION ALL SELECT 'ROUGE-L', round(coalesce(avg(rougeL), 0.0), 4) FROM lcs""",
            "eval_pairs", **_bleu_ctes(), **_rouge_stemmed_ctes(),
        )
    ),
    "eval_results": with_ctes(
        """SELECT row_id, prompt, prediction, reference, length(prediction) || ' chars' AS judgment
           FROM eval_pairs WHERE prediction <> ''""",
        "eval_pairs",
    ),
    "embedding_match": with_ctes("SELECT pair_id, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1 FROM m", "emb_pairs", **_EMBEDDING),
    "embedding_match_pruned": with_ctes(
        """SELECT e.pair_id, round(coalesce(p, 0), 6) AS p, round(coalesce(r, 0), 6) AS r, round(coalesce(f1, 0), 6) AS f1
           FROM (SELECT DISTINCT pair_id FROM emb_groups) e LEFT JOIN m USING (pair_id)""",
        "emb_groups", **{**_EMBEDDING, "c": _EMBEDDING["c"].replace("emb_pairs", "emb_groups")},
    ),
    "embedding_report": with_ctes(
        """SELECT 'BERTScore-P' AS metric, round(avg(p), 4) AS value FROM m UNION ALL SELECT 'BERTScore-R', round(avg(r), 4) FROM m
           UNION ALL SELECT 'BERTScore-F1', round(avg(f1), 4) FROM m""",
        "emb_pairs", **_EMBEDDING,
    ),
    "batch_score": with_ctes(
        "SELECT row_id, prompt, length(prompt) || ' chars: ' || prompt AS response, NULL::VARCHAR AS error FROM eval_pairs",
        "eval_pairs",
    ),
    "batch_score_errors": with_ctes(
        """SELECT row_id, prompt, CASE WHEN NOT contains(prompt, 'que') THEN length(prompt) || ' chars: ' || prompt END AS response,
                  CASE WHEN contains(prompt, 'que') THEN 'ValueError: cannot answer' END AS error FROM eval_pairs""",
        "eval_pairs",
    ),
    "judge_run": with_ctes(
        f"""SELECT row_id, criterion, (1 + length({upto('q', 1024)}) % 10) || ' of 10' AS judgment,
                  NULL::VARCHAR AS error FROM asked""",
        "eval_pairs",
        asked="""SELECT row_id, criterion, 'Evaluate the following response based on: ' || criterion || chr(10) || chr(10) ||
                   'Prompt: ' || prompt || chr(10) || chr(10) || 'Response: ' || prediction || chr(10) || chr(10) ||
                   'Score (1-10) and brief reasoning:' AS q
                 FROM eval_pairs, unnest(['helpfulness', 'accuracy', 'coherence', 'safety', 'relevance']) c(criterion)""",
    ),
    "loss_log": with_ctes(
        "SELECT run_id, step, round(train_loss, 4) AS train_loss, round(eval_loss, 4) AS eval_loss FROM train_logs WHERE train_loss IS NOT NULL",
        "train_logs",
    ),
    "loss_curve": with_ctes(
        "SELECT run_id, step, round(max(train_loss), 4) AS train_loss, round(max(eval_loss), 4) AS eval_loss FROM train_logs GROUP BY run_id, step",
        "train_logs",
    ),
    "final_loss": with_ctes(
        """SELECT run_id, max(step) AS step, round(arg_max(train_loss, step), 4) AS train_loss
           FROM train_logs WHERE train_loss IS NOT NULL GROUP BY run_id""",
        "train_logs",
    ),
    "best_step": with_ctes(
        """SELECT run_id, step, round(eval_loss, 4) AS eval_loss FROM (
             SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY eval_loss, step) AS rn
             FROM train_logs WHERE eval_loss IS NOT NULL) t WHERE rn = 1""",
        "train_logs",
    ),
    "early_stop_step": with_ctes(
        """SELECT run_id, min(step) AS stop_step FROM (
             SELECT run_id, step, row_number() OVER (PARTITION BY run_id, island ORDER BY step) - 1 AS since FROM (
               SELECT run_id, step, sum(improved) OVER (PARTITION BY run_id ORDER BY step) AS island FROM (
                 SELECT run_id, step, (best IS NULL OR eval_loss < best)::INTEGER AS improved FROM (
                   SELECT run_id, step, eval_loss, min(eval_loss) OVER (PARTITION BY run_id ORDER BY step
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
                   FROM train_logs WHERE eval_loss IS NOT NULL) a) b) c) d WHERE since >= 3 GROUP BY run_id""",
        "train_logs",
    ),
    "sink_csv_roundtrip": with_ctes("SELECT instruction AS prompt, output AS response FROM conv_pairs", "conv_pairs"),
    "sink_split_roundtrip": """
        SELECT doc_id, text, CASE WHEN row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) <= ceil(0.1::DOUBLE * (count(*) OVER ()))
               THEN 'test' ELSE 'train' END AS split FROM documents""",
    "dataset_card": """
        WITH f AS (SELECT count(*) AS n, round(avg(length(text)), 0)::BIGINT AS mean, min(length(text)) AS lo,
                          max(length(text)) AS hi, count(*) FILTER (length(text) > 2048) AS over FROM documents)
        SELECT 0 AS line_no, '## Training Data' AS line UNION ALL SELECT 1, '- Examples: ' || n FROM f
        UNION ALL SELECT 2, '- Average length: ' || mean || ' chars' FROM f
        UNION ALL SELECT 3, '- Shortest and longest: ' || lo || ' and ' || hi FROM f
        UNION ALL SELECT 4, '- Over 2048 chars: ' || over FROM f""",
    "registry_publish": """
        SELECT 'unknown' AS base_model, 'first' AS notes, '1.0' AS version, count(*)::BIGINT AS num_examples, true AS stamped
        FROM documents""",
    "registry_list": with_ctes(
        """SELECT 'metadata_v' || version || '.json' AS name, version, (SELECT count(*) FROM conv_pairs)::BIGINT AS num_examples
           FROM unnest(['1.0', '1.10', '1.2']) v(version)""",
        "conv_pairs",
    ),
    "stream_clean_format": """
        SELECT doc_id, '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) AS text
        FROM documents WHERE length(text) BETWEEN 50 AND 2048""",
    "stream_loss_window": with_ctes(
        """SELECT run_id, date_trunc('hour', ts) AS window_start, count(*)::BIGINT AS n, round(avg(train_loss), 4) AS train_loss
           FROM train_logs WHERE train_loss IS NOT NULL GROUP BY run_id, date_trunc('hour', ts)
           HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM train_logs WHERE train_loss IS NOT NULL)""",
        "train_logs",
    ),
}

for _k, _t, _key, _len, _ in WHOLE:
    ORACLES[f"len_{_k}"] = with_ctes(f"SELECT {_key}, ({_len})::BIGINT AS n FROM {_t}", *[c for c in (_t,) if c in CTE])
    ORACLES[f"quality_{_k}"] = with_ctes(f"SELECT {_key} FROM {_t} WHERE {BOUNDS[_k]}", *[c for c in (_t,) if c in CTE])
for _k, _t, _key, _, _keep in BLANKED:
    ORACLES[f"drop_empty_{_k}"] = with_ctes(f"SELECT {_key} FROM {_t} WHERE {_keep}", _t)
ORACLES["augment_phrases"] = _recursive(with_ctes(
    """SELECT row_id, instruction, output, 0 AS copy_no FROM conv_pairs UNION ALL
       SELECT p.row_id, coalesce(c.changed, p.instruction), p.output, 1 FROM conv_pairs p LEFT JOIN changed c ON c.row_id = p.row_id""",
    "conv_pairs",
    texts=f"SELECT row_id, {toks('instruction')} AS w FROM conv_pairs",
    lex="""SELECT DISTINCT phrase FROM (
             SELECT unnest([array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' '), array_to_string(w[3:3], ' '), array_to_string(w[3:4], ' ')]) AS phrase FROM texts) t
           WHERE phrase <> ''""",
    places="SELECT row_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts",
    matches="""SELECT row_id, i, max(n) AS n FROM (SELECT row_id, w, i, unnest([1, 2, 3]) AS n FROM places) t
               WHERE i + n - 1 <= len(w) AND array_to_string(w[i : i + n - 1], ' ') IN (SELECT phrase FROM lex) GROUP BY row_id, i""",
    picked="""SELECT row_id, 0::BIGINT AS i, 1::BIGINT AS n FROM texts
              UNION ALL
              SELECT row_id, i, n FROM (
                SELECT m.row_id, m.i, m.n, row_number() OVER (PARTITION BY m.row_id ORDER BY m.i) AS rn
                FROM picked p JOIN matches m ON m.row_id = p.row_id AND m.i >= p.i + p.n) t WHERE rn = 1""",
    ranked="""SELECT p.row_id, p.i, p.n, len(w) AS size, array_to_string(w[p.i : p.i + p.n - 1], ' ') AS phrase,
                row_number() OVER (PARTITION BY p.row_id ORDER BY md5('42-' || p.row_id || '-1-' || (p.i - 1))) AS rk
              FROM picked p JOIN texts USING (row_id) WHERE p.i > 0""",
    chosen="SELECT * FROM ranked WHERE rk <= greatest(1, least(10, floor(size * 0.3::DOUBLE)))",
    changed="""SELECT l.row_id, string_agg(CASE WHEN c.row_id IS NULL THEN l.w[l.i] WHEN c.i = l.i THEN '<' || c.phrase || '>' END, ' ' ORDER BY l.i) AS changed
               FROM places l LEFT JOIN chosen c ON c.row_id = l.row_id AND l.i BETWEEN c.i AND c.i + c.n - 1
               WHERE l.row_id IN (SELECT row_id FROM chosen) GROUP BY l.row_id""",
))
for _k, _same in (
    ("vocab_heavy", "vocab_build"),
    ("src_csv_ranges", "src_csv"), ("src_json_array_ranges", "src_json_array"), ("src_eval_mixed", "src_eval"),
    ("batch_score_resumed", "batch_score"), ("early_stop_nan", "early_stop_step"), ("stream_early_stop", "early_stop_step"),
    ("stream_loss_nan", "stream_loss_window"), ("stream_loss_upsert", "stream_loss_window_all"), ("augment_synonym", "augment_synonym_joined"),
):
    ORACLES[_k] = ORACLES[_same]
ORACLES["registry_replay"] = with_ctes(
    "SELECT 'metadata_v1.0.json' AS name, '1.0' AS version, count(*)::BIGINT AS num_examples FROM conv_pairs", "conv_pairs"
)
for _k in ("encode_documents", "encode_preference"):
    ORACLES[f"{_k}_joined"] = ORACLES[_k]

"""Word lists, patterns and code tables that results depend on.

Patterns use only syntax that Java, Python and RE2 read alike (no look-around, no back-references).
"""

# Names that are built-in functions, never calls to catalog objects.
SYSTEM_FUNCTIONS = [
    "GETDATE", "GETUTCDATE", "SYSDATETIME", "NEWID", "ISNULL", "COALESCE",
    "CAST", "CONVERT", "LEN", "TRIM", "LTRIM", "RTRIM", "UPPER", "LOWER",
    "SUBSTRING", "REPLACE", "CHARINDEX", "PATINDEX", "LEFT", "RIGHT",
    "DATEADD", "DATEDIFF", "DATEPART", "YEAR", "MONTH", "DAY",
    "ABS", "CEILING", "FLOOR", "ROUND", "POWER", "SQRT",
    "COUNT", "SUM", "AVG", "MIN", "MAX", "ROW_NUMBER", "RANK", "DENSE_RANK",
    "ISNUMERIC", "ISDATE", "NULLIF", "IIF", "CHOOSE",
    "FORMAT", "CONCAT", "STRING_AGG", "STUFF", "QUOTENAME",
    "OBJECT_ID", "OBJECT_NAME", "DB_ID", "DB_NAME", "SCHEMA_NAME",
    "SCOPE_IDENTITY", "IDENT_CURRENT", "ERROR_MESSAGE", "ERROR_NUMBER",
    "NOW", "CURRENT_TIMESTAMP", "CURRENT_DATE", "CURRENT_USER",
    "GREATEST", "LEAST", "LENGTH", "SUBSTR", "INSTR", "NVL", "NVL2", "DECODE",
    "TO_CHAR", "TO_DATE", "TO_NUMBER", "SYSDATE", "SYSTIMESTAMP",
    "TRUNC", "MOD", "SIGN", "CHR", "ASCII",
    "RAISE_APPLICATION_ERROR", "ARRAY_AGG", "JSON_AGG", "JSONB_AGG",
    "JSON_BUILD_OBJECT", "REGEXP_MATCH", "REGEXP_REPLACE",
    "NEXTVAL", "CURRVAL", "SETVAL",
]

# Words after EXECUTE that are syntax, not a callee.
EXECUTE_SYNTAX_WORDS = ["IMMEDIATE", "AS"]

# PL/SQL words that look like a bare call at the start of a line.
PLSQL_KEYWORDS = [
    "IF", "ELSIF", "WHILE", "FOR", "LOOP", "RETURN", "RAISE", "EXCEPTION",
    "BEGIN", "END", "DECLARE", "CURSOR", "OPEN", "CLOSE", "FETCH",
    "COMMIT", "ROLLBACK", "SAVEPOINT", "NULL", "EXIT", "CONTINUE",
    "DBMS_OUTPUT", "PUT_LINE", "RAISE_APPLICATION_ERROR",
]

# Words that cannot be a table name after FROM, JOIN, INTO, UPDATE, DELETE or MERGE.
NON_TABLE_WORDS = [
    "SET", "BEGIN", "END", "THEN", "AS", "ON", "AND", "OR", "NOT",
    "NULL", "WHERE", "VALUES", "SELECT", "EXEC", "EXECUTE", "DECLARE",
    "IF", "ELSE", "WHILE", "FOR", "RETURN", "OUTPUT", "INSERTED",
    "DELETED", "TOP", "DISTINCT", "CASE", "WHEN", "EXISTS",
]

# Call patterns as (rank, kind, pattern, groups, confidence, dialects).
CALL_PATTERNS = [
    (1, "exec", r"\b(?:EXEC(?:UTE)?|CALL)\s+(?:\[?(\w+)\]?\.)?(?:\[?(\w+)\]?\.)?(\[?\w+\]?)", 3, 0.90, None),
    (3, "perform", r"\bPERFORM\s+(\w+)\.(\w+)\s*\(", 2, 0.95, None),
    (4, "assigned", r"(?::=|INTO|SELECT)\s+(\w+)\.(\w+)\s*\(", 2, 0.85, None),
    (5, "bare", r"(?m)^[ \t]+(\w+)\s*\(", 1, 0.70, ["plsql"]),
]
DYNAMIC_EXEC_PATTERN = r"\b(?:EXEC(?:UTE)?)\s*\(\s*@"
LINKED_SERVER_PATTERN = r"\[?(\w+)\]?\.\[?(\w+)\]?\.\[?(\w+)\]?\.\[?(\w+)\]?"
DYNAMIC_TARGET = "<dynamic_sql>"

# Dynamic-SQL census as (rule, pattern, description).
DYNAMIC_SQL_PATTERNS = [
    (1, r"EXEC(?:UTE)?\s*\(\s*@", "Dynamic EXEC with variable"),
    (2, r"EXEC(?:UTE)?\s*\(\s*'[^']*'\s*\+", "String concatenation in EXEC"),
    (3, r"EXECUTE\s+IMMEDIATE", "PL/SQL EXECUTE IMMEDIATE"),
    (4, r"EXECUTE\s+format\s*\(", "PG EXECUTE format()"),
]

# Security rules as (id, dialect or *, pattern, severity, type, message, recommendation).
SECURITY_RULES = [
    (1, "*", r"EXEC(?:UTE)?\s*\(\s*@\w+", "high", "sql_injection_risk",
     "Dynamic SQL execution with variable",
     "Use parameterized queries or sp_executesql with parameters"),
    (2, "*", r"EXEC(?:UTE)?\s*\(\s*'[^']*'\s*\+", "high", "sql_injection_risk",
     "String concatenation in EXEC", "Use parameterized queries"),
    (3, "*", r"\bxp_cmdshell\b", "critical", "os_command_execution",
     "xp_cmdshell allows OS command execution", "Remove xp_cmdshell; use safer alternatives"),
    (4, "*", r"\bOPENROWSET\b|\bOPENDATASOURCE\b", "high", "external_access",
     "External data access via OPENROWSET/OPENDATASOURCE",
     "Review if external data access is necessary"),
    (5, "*", r"\bGRANT\b", "medium", "privilege_escalation",
     "GRANT statement in procedure body", "Avoid granting permissions inside stored procedures"),
    (6, "*", r"WITH\s+EXECUTE\s+AS\s+", "medium", "impersonation",
     "EXECUTE AS context switching", "Review for least-privilege principle"),
    (7, "tsql", r"sp_executesql\s+@\w+", "medium", "sql_injection_risk",
     "sp_executesql with dynamic string", "Verify parameters are properly bound"),
    (8, "plpgsql", r"SECURITY\s+DEFINER", "medium", "security_definer",
     "Function runs with SECURITY DEFINER (owner privileges)", "Consider SECURITY INVOKER"),
    (9, "plpgsql", r"\bdblink\b", "high", "external_access",
     "dblink usage — cross-database access",
     "Review connection strings for hardcoded credentials"),
    (10, "plsql", r"EXECUTE\s+IMMEDIATE", "high", "sql_injection_risk",
     "PL/SQL EXECUTE IMMEDIATE", "Use bind variables with USING clause"),
    (11, "plsql", r"DBMS_SQL", "medium", "dynamic_sql",
     "DBMS_SQL — low-level dynamic SQL", "Prefer EXECUTE IMMEDIATE with bind variables"),
    (12, "plsql", r"UTL_HTTP|UTL_FILE|UTL_SMTP", "high", "external_access",
     "Oracle utility package for external access", "Review permissions and URL/path validation"),
    (13, "plsql", r"AUTHID\s+DEFINER", "medium", "privilege_escalation",
     "AUTHID DEFINER — runs with owner privileges", "Consider AUTHID CURRENT_USER"),
]

# The credential check.
CREDENTIAL_PATTERN = r"""(?:password|pwd|passwd|secret)\s*[=:]\s*['"]([^'"]+)['"]"""
CREDENTIAL_FINDING = ("critical", "hardcoded_credentials", "Hardcoded credentials detected",
                      "Use environment variables or a secrets manager")

# Present / not-present checks as
# (id, dialect, present, absent or None, severity, type, message, recommendation).
CONDITIONAL_RULES = [
    (1, "plpgsql", r"SECURITY\s+DEFINER", None, "medium", "security_definer",
     "Function runs with SECURITY DEFINER (owner privileges)",
     "Consider SECURITY INVOKER; ensure owner has minimal privileges"),
    (2, "plpgsql", r"EXECUTE\s+format\s*\(", r"format\s*\([^,]+,\s*\$\d+", "high", "sql_injection_risk",
     "EXECUTE with format() — verify %I/%L usage",
     "Use %I for identifiers and %L for literals in format()"),
    (3, "plpgsql", r"\bdblink\b", None, "high", "external_access",
     "dblink usage — cross-database access",
     "Review connection strings for hardcoded credentials"),
    (4, "plsql", r"EXECUTE\s+IMMEDIATE", r"USING\s+", "high", "sql_injection_risk",
     "EXECUTE IMMEDIATE without USING clause", "Use bind variables with USING clause"),
    (5, "plsql", r"DBMS_SQL", None, "medium", "dynamic_sql",
     "DBMS_SQL usage — low-level dynamic SQL interface",
     "Prefer EXECUTE IMMEDIATE with bind variables when possible"),
    (6, "plsql", r"UTL_HTTP|UTL_FILE|UTL_SMTP", None, "high", "external_access",
     "Oracle utility package for external access (HTTP/File/SMTP)",
     "Review external access permissions and URL/path validation"),
    (7, "plsql", r"AUTHID\s+DEFINER", None, "medium", "privilege_escalation",
     "Procedure runs with AUTHID DEFINER (owner privileges)",
     "Consider AUTHID CURRENT_USER for least-privilege"),
]

# Severities from worst to mildest.
SEVERITIES = ["critical", "high", "medium", "low", "info"]

# Complexity keywords and risk limits (highest cyclomatic value of each level).
BRANCH_WORDS = r"\b(?:IF|ELSE\s*IF|ELSIF|WHEN|WHILE|LOOP|FOR|CURSOR|EXCEPTION|CATCH)\b"
LOOP_WORDS = r"\b(?:WHILE|LOOP|FOR|CURSOR)\b"
BLOCK_WORDS = r"\b(BEGIN|IF|WHILE|LOOP|FOR|CASE|END)\b"
RISK_LIMITS = [("low", 5), ("moderate", 10), ("high", 20)]
RISK_ABOVE = "critical"

# Operations that write, and names of temporary tables.
WRITE_OPERATIONS = ["INSERT", "UPDATE", "DELETE", "MERGE", "TRUNCATE"]
TEMP_TABLE_PATTERN = r"^(?:[#@]|(?i)TEMP)"

# Words that open a statement at the start of a line, and lines that close one.
STATEMENT_OPENERS = (
    r"^\s*\b(?:IF|ELSIF|ELSE|WHEN|WHILE|FOR|FORALL|LOOP|BEGIN|END|DECLARE|SET|SELECT|INSERT|UPDATE|"
    r"DELETE|MERGE|EXEC|EXECUTE|CALL|PERFORM|RETURN|RAISE|RAISERROR|THROW|PRINT|"
    r"BREAK|CONTINUE|EXIT|GOTO|WAITFOR|OPEN|CLOSE|FETCH|DEALLOCATE|CURSOR|"
    r"CREATE|ALTER|DROP|TRUNCATE|GRANT|REVOKE|DENY|COMMIT|ROLLBACK|"
    r"SAVE|BEGIN\s+TRY|BEGIN\s+CATCH|END\s+TRY|END\s+CATCH|EXCEPTION)\b"
)
CLOSING_LINES = ["END", "END TRY", "END CATCH", "END LOOP", "END IF", ")"]

# Return-type patterns per dialect.
RETURN_PATTERNS = {
    "tsql": r"RETURNS\s+(\w+(?:\([^)]*\))?)",
    "plpgsql": r"RETURNS\s+((?:SETOF\s+)?\w+(?:\[\])?(?:\([^)]*\))?)",
    "plsql": r"RETURN\s+(\w+(?:\([^)]*\))?)",
}
OBJECT_KIND_PATTERN = (
    r"\bCREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(PROCEDURE|PROC|FUNCTION|TRIGGER|VIEW|PACKAGE)\b"
)

# Variable-reference passes as (rank, type, pattern, groups).
VARIABLE_PATTERNS = [
    (1, "parameter_in", r"@(\w+)\s+([\w]+(?:\([^)]*\))?)\s*(?:=\s*[^,)]+)?\s*(?:,|\))", 2),
    (2, "parameter_out", r"@(\w+)\s+([\w]+(?:\([^)]*\))?)\s+(?:OUT(?:PUT)?)", 2),
    (3, "declare", r"\bDECLARE\s+(@\w+)\s+([\w]+(?:\([^)]*\))?)", 2),
    (4, "set", r"\bSET\s+(@\w+)\s*=\s*(.+?)(?:;|\n|$)", 2),
    (5, "select_into", r"\bSELECT\s+(.+?)\s+INTO\s+(@\w+)", 2),
    (6, "where_clause", r"\bWHERE\b.+?(@\w+)", 1),
    (7, "insert_value", r"\bVALUES\s*\(.*?(@\w+)", 1),
    (8, "update_set", r"\bSET\s+\w+\s*=\s*(@\w+)", 1),
    (9, "exec_named", r"\b(?:EXEC(?:UTE)?)\s+((?:\[?\w+\]?\.)*\[?\w+\]?)\s+((?:@\w+\s*=\s*@\w+(?:\s*,\s*)?)+)", 2),
    (10, "exec_positional", r"\b(?:EXEC(?:UTE)?)\s+((?:\[?\w+\]?\.)*\[?\w+\]?)\s+(@\w+(?:\s*,\s*@\w+)*)\s*(?:;|\n|$)", 2),
    (11, "condition", r"\b(?:IF|WHILE|WHEN)\s+.*?(@\w+)", 1),
    (12, "return", r"\bRETURN\s+(?:\()?.*?(@\w+)", 1),
]
NAMED_ARGUMENT_PATTERN = r"@(\w+)\s*=\s*(@\w+)"
UPDATE_WORD = r"\bUPDATE\b"
SET_LOOK_BACK = 100
UPDATE_SET_LOOK_BACK = 200

# Line classes in order of precedence.
LINE_CLASSES = [
    ("condition", r"^IF\b"),
    ("loop", r"^(?:WHILE|LOOP|FOR)\b"),
    ("call", r"^(?:EXEC|EXECUTE|CALL|PERFORM)\b"),
    ("statement", r"^(?:INSERT|UPDATE|DELETE|MERGE|SELECT\s+INTO)\b"),
    ("raise", r"^(?:RETURN|RAISE|RAISERROR|THROW)\b"),
    ("error_handler", r"^(?:BEGIN\s+TRY|BEGIN\s+CATCH|EXCEPTION)\b"),
]

# Variables named in a statement.
AT_VARIABLE = r"@@?\w+"
PREFIX_VARIABLE = r"\b([vplcio]_\w+)\b"
DECLARED_VARIABLE = r"\bDECLARE\s+(@\w+)\s+[\w]+(?:\([^)]*\))?"
SET_ASSIGNMENT = r"(?s)^SET\s+(@\w+)\s*=\s*(.+)"

# Header keys in English, Spanish and Portuguese spelling.
HEADER_PATTERNS = [
    ("author", r"--\s*(?:Author|Autor|Criado\s*por)\s*:\s*<?(.+?)>?\s*$"),
    ("createDate", r"--\s*(?:Create[d]?\s*date|Fecha\s*de\s*creaci[oó]n|Data\s*de\s*cria[cç][aã]o)\s*:\s*<?(.+?)>?\s*$"),
    ("updateDate", r"--\s*(?:Update[d]?\s*date|Modify\s*date|Fecha\s*de\s*modificaci[oó]n|Data\s*de\s*modifica[cç][aã]o)\s*:\s*<?(.+?)>?\s*$"),
    ("updateAuthor", r"--\s*(?:Update[d]?\s*(?:by|author)|Modified\s*by|Modificado\s*por|Atualizado\s*por)\s*:\s*<?(.+?)>?\s*$"),
    ("description", r"--\s*(?:Description|Descripci[oó]n|Descri[cç][aã]o)\s*:\s*<?(.+?)>?\s*$"),
    ("ticket", r"--\s*(?:Gemini|Azure|Jira|Ticket|Issue|Story|Task|Bug)\s*:\s*<?(.+?)>?\s*$"),
    ("version", r"--\s*(?:Version|Versi[oó]n|Vers[aã]o|Ver)\s*:\s*<?(.+?)>?\s*$"),
    ("purpose", r"--\s*(?:Purpose|Prop[oó]sito|Objetivo)\s*:\s*<?(.+?)>?\s*$"),
]
BLOCK_COMMENT = r"(?s)/\*\s*\n(.*?)\*/"
HEADER_LINES = 50
BLOCK_SKIP_WORDS = ["AUTHOR", "DATE", "CREATE", "UPDATE", "VERSION", "GEMINI", "AZURE"]
CHANGE_ENTRY = (
    r"--\s*(?:Author|Modified)\s*:\s*<?(.+?)>?\s*\n"
    r"--\s*(?:Update[d]?\s*date|Date)\s*:\s*<?(.+?)>?\s*\n"
    r"--\s*Description\s*:\s*<?(.+?)>?\s*$"
)
COMMENT_SKIP_WORDS = [
    "AUTHOR", "AUTOR", "CREATE", "CRIADO", "UPDATE", "ATUALIZADO",
    "DESCRIPTION", "DESCRIPCI", "DESCRI", "GEMINI",
    "AZURE", "JIRA", "VERSION", "VERSI", "VERS",
    "PURPOSE", "PROP", "OBJETIVO", "=====", "-----",
]
TRAILING_COMMENT = r"^(.+?)\s*--\s*(.+)$"
LANGUAGE_INDICATORS = {
    "en": [
        r"(?i)\b(?:Created?\s+(?:date|by)|Updated?\s+(?:date|by)|Modified\s+by|Description|Purpose|Author|Version|Changes|Changelog)\b",
    ],
    "es": [
        r"(?i)\b(?:Fecha\s+de\s+creaci[oó]n|Modificado\s+por|Descripci[oó]n|Prop[oó]sito|Objetivo|Autor|Versi[oó]n|Fecha|Cambios|Creado\s+por|Actualizado)\b",
        r"[áéíóúñ¿¡]",
    ],
    "pt": [
        r"(?i)\b(?:Data\s+de\s+cria[cç][aã]o|Modificado\s+por|Descri[cç][aã]o|Prop[oó]sito|Objetivo|Autor|Vers[aã]o|Altera[cç][oõ]es|Criado\s+por|Atualizado)\b",
        r"[ãõçâêôà]",
    ],
}

# Words of a generated description in Spanish and Portuguese.
DESCRIPTION_WORDS = {
    "es": [("Procedure", "Procedimiento"), ("Function", "Función"), ("parameters", "parámetros"),
           ("table accesses", "accesos a tablas"), ("calls", "llama a"), ("with", "con"),
           ("reads from", "lee de"), ("writes to", "escribe en")],
    "pt": [("Procedure", "Procedimento"), ("Function", "Função"), ("parameters", "parâmetros"),
           ("table accesses", "acessos a tabelas"), ("calls", "chama"), ("with", "com"),
           ("reads from", "lê de"), ("writes to", "escreve em")],
}

# Dialect names, engines, default schemas and admission limits.
DIALECT_ALIASES = {
    "tsql": "tsql", "sqlserver": "tsql",
    "plpgsql": "plpgsql", "postgres": "plpgsql", "postgresql": "plpgsql",
    "plsql": "plsql", "oracle": "plsql",
}
DEFAULT_SCHEMAS = {"tsql": "dbo", "plpgsql": "public", "plsql": "DBO"}
MAX_TEXT_LENGTH = 500_000
SYSTEM_SCHEMAS = {
    "tsql": ["sys", "INFORMATION_SCHEMA"],
    "plpgsql": ["pg_catalog", "information_schema"],
    "plsql": ["SYS", "SYSTEM", "DBSNMP", "OUTLN", "MDSYS", "CTXSYS", "XDB", "WMSYS", "ORDDATA", "ORDSYS"],
}

# Job states.
RUNNING_STATES = ["pending", "extracting", "parsing", "analyzing"]
FINISHED_STATES = ["completed", "failed", "cancelled"]

# Metadata codes.
RELATION_KINDS = {"r": "table", "v": "view", "m": "materialized_view", "f": "external"}
KEY_ACTIONS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}
ROUTINE_KINDS = {"P": "procedure", "FN": "function", "IF": "function", "TF": "function",
                 "TR": "trigger", "V": "view"}
LENGTH_TYPES = ["varchar", "nvarchar", "char", "nchar"]
DECIMAL_TYPES = ["decimal", "numeric"]
PAGE_BYTES = 8192

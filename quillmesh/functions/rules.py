"""They must be these for results to agree with other implementations of the same rules."""

from __future__ import annotations

#: Words that carry no identifier.
STOPWORDS = frozenset(
    "a an the and or of for to in on at is are was were be been being do does did done have has had this that these those "
    "what where when why how who which show find look get with without by from as it its i you we code function class method file".split()
)

#: Languages by lower-cased file extension.
LANGUAGE_BY_EXTENSION = {
    ".java": "java", ".kt": "kotlin", ".scala": "scala", ".groovy": "groovy", ".vue": "vue", ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".rs": "rust", ".go": "go",
    ".rb": "ruby", ".swift": "swift", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp", ".yml": "yaml",
    ".yaml": "yaml", ".toml": "toml", ".json": "json", ".jsonc": "json", ".md": "markdown", ".mdx": "markdown", ".feature": "gherkin",
    ".sql": "sql", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".properties": "properties", ".graphql": "graphql", ".gql": "graphql",
    ".html": "html", ".css": "css", ".scss": "css", ".xml": "xml",
}
#: Languages by file name.
LANGUAGE_BY_NAME = {"Dockerfile": "dockerfile", "Makefile": "make", "Justfile": "just", "Procfile": "procfile"}

#: Parts of a path that mark test code, in hits and in graph nodes.
TEST_PATHS = ("test_", "_test.", ".test.", "/tests/", "/test/", "Test.")
NODE_TEST_PATHS = ("test_", "_test", "/tests/", "/test/", ".spec.", ".test.")

#: Limits of files that are indexed, of chunks and of snippets.
MAX_FILE_BYTES, SNIFF_BYTES, MAX_CHUNK_CHARS, MIN_CHUNK_CHARS = 524_288, 8_192, 24_000, 20

#: Query intents in order of precedence: (intent, pattern); group 1 is the subject.
SYMBOL = r"[`'\"]?([A-Z_a-z]\w*(?:\.[A-Z_a-z]\w*)*)[`'\"]?"
INTENTS = (
    ("find_callers", rf"(?:what|who|which)\s+(?:\w+\s+)?(?:calls?|invokes?|uses?)\s+(?:the\s+)?{SYMBOL}"),
    ("find_callers", rf"callers?\s+(?:of|for)\s+{SYMBOL}"),
    ("find_callers", rf"{SYMBOL}\s+(?:is\s+)?called\s+(?:by|from|where)"),
    ("find_callers", rf"where\s+is\s+{SYMBOL}\s+(?:called|invoked|used)"),
    ("find_tests_for", rf"tests?\s+(?:for|of|covering)\s+{SYMBOL}"),
    ("find_tests_for", rf"how\s+is\s+{SYMBOL}\s+tested"),
    ("find_tests_for", rf"what\s+tests?\s+{SYMBOL}"),
    ("find_tests_for", rf"test\s+coverage\s+(?:for|of)\s+{SYMBOL}"),
    ("find_related", rf"what\s+(?:is\s+)?relates?\s+to\s+{SYMBOL}"),
    ("find_related", rf"related\s+(?:to|code|symbols?)\s+(?:for|of)?\s*{SYMBOL}"),
    ("find_related", rf"{SYMBOL}\s+(?:dependencies|dependents|connections)"),
    ("trace_feature", r"trace\s+(?:the\s+)?(?:feature\s+)?[`'\"]?(.+?)[`'\"]?(?:\s+flow)?$"),
    ("trace_feature", r"follow\s+(?:the\s+)?[`'\"]?(.+?)[`'\"]?\s+(?:flow|path)"),
    ("trace_feature", r"how\s+does\s+(?:the\s+)?[`'\"]?(.+?)[`'\"]?\s+(?:flow|work|execute)"),
    ("trace_feature", r"execution\s+(?:path|flow)\s+(?:for|of)\s+[`'\"]?(.+?)[`'\"]?$"),
    ("get_symbol", rf"show\s+(?:me\s+)?(?:the\s+)?{SYMBOL}$"),
    ("get_symbol", rf"get\s+(?:the\s+)?(?:definition\s+(?:of|for)\s+)?{SYMBOL}$"),
    ("get_symbol", rf"where\s+is\s+{SYMBOL}\s+defined"),
    ("get_symbol", rf"^{SYMBOL}$"),
)

#: Kinds of hypothetical-document prompts in order of precedence; `other` if none matches.
PROMPT_KINDS = (
    ("function", r"\b(function|method|def|fn)\b"),
    ("class", r"\b(class|type|interface|struct|enum)\b"),
    ("how", r"^how\b"),
    ("where", r"\b(where|find|locate)\b"),
    ("test", r"\b(tests?|specs?|asserts?|assertions?)\b"),
    ("error", r"\b(bug|fix|error|issue|debug)\b"),
)

#: Words that open a question.
QUESTION_WORDS = ("how", "what", "where", "when", "who", "which", "why", "does", "is", "are", "can", "should")

#: Architectural anchors: name, category, symbol, content and path patterns, kinds, boost.
ANCHORS = (
    ("controller", "entry_point", (".*Controller$", ".*Handler$", ".*Endpoint$", ".*Resource$"), ("@Controller", "@RestController", "@RequestMapping", "@GetMapping|@PostMapping|@PutMapping|@DeleteMapping", r"@app\.route|@router\.", r"@Get\(|@Post\(|@Put\(|@Delete\("), ("/controllers?/", "/handlers?/", "/endpoints?/", "/api/"), ("class", "function", "method"), 1.8),
    ("resolver", "entry_point", (".*Resolver$", ".*Query$", ".*Mutation$"), ("@Resolver", r"@Query\(", r"@Mutation\(", "@ResolveField"), ("/resolvers?/", "/graphql/"), ("class", "function"), 1.8),
    ("entity", "domain", (".*Entity$", ".*Aggregate$", ".*Root$"), ("@Entity", "@AggregateRoot", "@Document", r"@Table\(", r"class.*\(.*Model\)", r"class.*\(.*Base\)"), ("/domain/", "/entities/", "/models/", "/aggregates/"), ("class",), 1.6),
    ("repository", "infrastructure", (".*Repository$", ".*Repo$", ".*DAO$", ".*Store$"), ("@Repository", "extends.*Repository", "implements.*Repository"), ("/repositories/", "/repos/", "/data/", "/persistence/"), ("class", "interface"), 1.5),
    ("service", "application", (".*Service$", ".*UseCase$", ".*Interactor$", ".*Manager$"), ("@Service", "@Injectable", "@Component"), ("/services/", "/usecases/", "/application/"), ("class",), 1.4),
    ("config", "infrastructure", (".*Config$", ".*Configuration$", ".*Settings$", ".*Options$"), ("@Configuration", "@ConfigurationProperties", "@Bean", r"settings\s*=", r"config\s*="), ("/config/", "/configuration/", "/settings/"), ("class", "module"), 1.3),
    ("main", "entry_point", ("^main$", "^Main$", "^App$", "^Application$"), (r"if\s+__name__\s*==\s*['\"]__main__['\"]", r"public\s+static\s+void\s+main\s*\(", r"func\s+main\s*\(", r"fn\s+main\s*\(", "@SpringBootApplication", r"createApp\(", r"bootstrapApplication\("), (r"/main\.", r"/__main__\.", r"/app\.", r"/index\."), ("function", "method", "class", "module"), 2.0),
    ("test_fixture", "test", (".*Test$", ".*Tests$", ".*Spec$", "^Test.*", "^test_.*"), ("@Test", r"@pytest\.fixture", r"describe\(", r"it\(", "def test_"), ("/tests?/", "/__tests__/", r"\.test\.", r"\.spec\.", r"_test\."), ("class", "function"), 1.2),
    ("middleware", "infrastructure", (".*Middleware$", ".*Interceptor$", ".*Filter$", ".*Guard$"), ("@Middleware", "@UseInterceptors", "@UseGuards", "implements.*Interceptor", "implements.*Filter"), ("/middleware/", "/interceptors/", "/filters/", "/guards/"), ("class",), 1.4),
)

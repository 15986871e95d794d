"""Pattern catalogues and guidance texts. Both can be replaced by the user."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# --------------------------------------------------------------------------------------------
# Regular expressions that recognise frameworks, authentication, routes, models
# and roles, in the order in which they are tried.

FRAMEWORKS = {
    "django": [r"from django\.", r"import django", r"DJANGO_SETTINGS_MODULE", r"django\.conf", r"manage\.py"],
    "flask": [r"from flask", r"import flask", r"Flask\(__name__"],
    "fastapi": [r"from fastapi", r"import fastapi", r"FastAPI\("],
    "express": [r"require\(['\"]express['\"]", r"from ['\"]express", r"express\(\)", r"app\.listen\("],
    "rails": [r"Rails\.application", r"class.*ApplicationController", r"ActiveRecord::Base"],
    "spring": [r"@RestController", r"@Controller", r"@SpringBootApplication", r"org\.springframework"],
    "laravel": [r"Illuminate\\", r"use App\\", r"Route::", r"Artisan"],
    "nestjs": [r"@nestjs/", r"@Controller\(\)", r"@Injectable\(\)"],
    "gin": [r"github.com/gin-gonic/gin", r"gin\.Default\(\)", r"gin\.New\(\)"],
    "echo": [r"github.com/labstack/echo", r"echo\.New\(\)"],
    "ruby": [r"require ['\"]sinatra", r"Sinatra::Application"],
    "php": [r"<\?php", r"use Symfony\\", r"use Laravel\\", r"\$app->", r"\$router->"],
}
FRAMEWORK_LANGUAGES = {
    "django": "python", "flask": "python", "fastapi": "python",
    "express": "javascript", "nestjs": "javascript",
    "rails": "ruby", "ruby": "ruby",
    "spring": "java",
    "laravel": "php", "php": "php",
    "gin": "go", "echo": "go",
}
AUTH = {
    "decorator": [
        r"@login_required", r"@auth_required", r"@requires_auth",
        r"@authenticated", r"@jwt_required", r"@permission_required",
    ],
    "middleware": [
        r"auth.*middleware", r"authentication.*middleware", r"AuthMiddleware", r"JWTMiddleware",
        r"SessionMiddleware", r"app\.use\(.*auth", r"router\.use\(.*auth",
    ],
    "guard": [r"AuthGuard", r"CanActivate", r"@UseGuards"],
    "interceptor": [r"AuthInterceptor", r"@UseInterceptors"],
    "dependency": [
        r"Depends\(get_current_user", r"Depends\(get_user", r"requireAuth", r"protect\(", r"verifyToken",
    ],
}
ROUTES = {
    "python": [
        r'@\w+\.(get|post|put|patch|delete|route)\s*\(\s*["\']([^"\']+)["\']',
        r'@app\.(get|post|put|patch|delete|route)\s*\(\s*["\']([^"\']+)["\']',
        r'@router\.(get|post|put|patch|delete)\s*\(\s*["\']([^"\']+)["\']',
        r'path\s*\(\s*["\']([^"\']+)["\']',
        r"urlpatterns\s*=",
    ],
    "javascript": [
        r'app\.(get|post|put|patch|delete)\s*\(\s*["\']([^"\']+)["\']',
        r'router\.(get|post|put|patch|delete)\s*\(\s*["\']([^"\']+)["\']',
        r'Route::(get|post|put|patch|delete)\s*\(\s*["\']([^"\']+)["\']',
    ],
    "go": [
        r'\.(GET|POST|PUT|PATCH|DELETE)\s*\(\s*["\']([^"\']+)["\']',
        r'Handle\w*\s*\(\s*["\']([^"\']+)["\']',
    ],
    "ruby": [r'(get|post|put|patch|delete)\s+["\']([^"\']+)["\']'],
    "java": [
        r'@(GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)\s*\(\s*["\']?([^"\')\s]+)',
    ],
}
MODELS = {
    "python": [
        r"class\s+\w+.*Model\b", r"class\s+\w+.*Base\b", r"class\s+\w+\(db\.Model\)",
        r"class\s+\w+\(Base\)", r"class\s+\w+\(models\.Model\)", r"class\s+\w+Schema",
        r"class\s+\w+\(BaseModel\)",
    ],
    "javascript": [
        r"mongoose\.model\(", r"Schema\(\{", r"Sequelize\.define\(", r"typeorm.*@Entity", r"prisma.*model",
    ],
    "go": [r"type\s+\w+\s+struct\s*\{"],
    "ruby": [r"class\s+\w+\s*<\s*ApplicationRecord", r"class\s+\w+\s*<\s*ActiveRecord::Base"],
    "java": [r"@Entity", r"@Table\("],
}
ROLES = [
    r"(?:is_)?admin", r"(?:is_)?superuser", r"role\s*=\s*", r"permission", r"staff", r"moderator",
    r"Role\.", r"ADMIN", r"STAFF", r"SUPERUSER", r"PERMISSION", r"has_role", r"check_permission",
    r"is_authorized",
]
MANIFESTS = {
    "package.json": "javascript",
    "requirements.txt": "python",
    "pyproject.toml": "python",
    "go.mod": "go",
    "Gemfile": "ruby",
    "composer.json": "php",
    "pom.xml": "java",
    "build.gradle": "java",
    "Cargo.toml": "rust",
}
# End of the fixed values.
# --------------------------------------------------------------------------------------------

DEFAULT_LANGUAGE = "python"
MAX_PATTERNS = 10_000


@dataclass(frozen=True)
class Catalogue:
    """Ordered patterns per kind and category; expressions are generated from it once per query."""

    frameworks: Mapping[str, Sequence[str]] = field(default_factory=lambda: FRAMEWORKS)
    framework_languages: Mapping[str, str] = field(default_factory=lambda: FRAMEWORK_LANGUAGES)
    auth: Mapping[str, Sequence[str]] = field(default_factory=lambda: AUTH)
    routes: Mapping[str, Sequence[str]] = field(default_factory=lambda: ROUTES)
    models: Mapping[str, Sequence[str]] = field(default_factory=lambda: MODELS)
    roles: Sequence[str] = field(default_factory=lambda: ROLES)
    manifests: Mapping[str, str] = field(default_factory=lambda: MANIFESTS)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for kind in ("frameworks", "auth", "routes", "models"):
            for c, (category, patterns) in enumerate(getattr(self, kind).items()):
                rows += [(kind, category, c, p, regex) for p, regex in enumerate(patterns)]
        rows += [("roles", "roles", 0, p, regex) for p, regex in enumerate(self.roles)]
        schema = "kind string, category string, category_ord int, pattern_ord int, regex string"
        return spark.createDataFrame(rows, schema)

    @classmethod
    def from_table(cls, patterns: DataFrame, **others) -> "Catalogue":
        """Read a pattern table. It configures the query, so it must be small; its size is checked."""
        rows = patterns.limit(MAX_PATTERNS + 1).collect()
        if len(rows) > MAX_PATTERNS:
            raise ValueError(f"a catalogue holds at most {MAX_PATTERNS} patterns")
        kinds: dict[str, dict[str, list[str]]] = {
            k: {} for k in ("frameworks", "auth", "routes", "models", "roles")
        }
        for r in sorted(rows, key=lambda r: (r.kind, r.category_ord, r.pattern_ord)):
            kinds[r.kind].setdefault(r.category, []).append(r.regex)
        roles = [p for patterns in kinds.pop("roles").values() for p in patterns]
        return cls(**kinds, roles=roles, **others)


DEFAULT_CATALOGUE = Catalogue()

# Guidance per class, given to the reviewer.
HINTS = {
    "IDOR": (
        "## Object access\n"
        "Follow every identifier that comes from a caller to the record it selects. Report the place\n"
        "if the record is read, changed or removed without a test that the caller may touch it.\n"
        "Nested resources need the test on each level; a logged-in caller is not yet an owner."
    ),
    "AUTH_BYPASS": (
        "## Authentication\n"
        "List the entry points and say which of them run without a proven identity. Look for debug\n"
        "switches, default accounts, alternative routes, comparison errors and checks that come after\n"
        "the action they should protect."
    ),
    "PRIVILEGE_ESC": (
        "## Privileges\n"
        "Find operations reserved for stronger roles and the code that decides on the role. Report\n"
        "roles taken from the request, checks made only in the client, and ways to grant oneself more."
    ),
    "MASS_ASSIGN": (
        "## Field binding\n"
        "Find request bodies copied as a whole into stored objects. Report fields such as owner, role,\n"
        "balance or status that a caller can thereby set."
    ),
    "JWT_ISSUE": (
        "## Tokens\n"
        "Check how tokens are signed, verified, expired and revoked. Report accepted weak or missing\n"
        "algorithms, unverified claims, secrets in the code and tokens that never end."
    ),
    "LOGIC_FLAW": (
        "## Workflow\n"
        "Reconstruct the intended order of steps and the values that must hold between them. Report\n"
        "steps that can be skipped, repeated or raced, and amounts a caller can choose."
    ),
    "DATA_EXPOSURE": (
        "## Disclosure\n"
        "Check what leaves the system in answers, errors and logs. Report secrets, personal data and\n"
        "internal details that the receiver does not need."
    ),
}


def hint_texts(requested: Sequence[str] | str | None = None, hints: Mapping[str, str] = HINTS) -> list[str]:
    """All hints in catalogue order, or those of the requested classes in the caller's order.

    A string is split on commas. Unknown names are skipped, so the result may be empty.
    """
    if isinstance(requested, str):
        requested = requested.split(",")
    if not requested:
        return list(hints.values())
    return [hints[name] for name in requested if name in hints]

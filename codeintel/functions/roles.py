"""Roles of symbols, visibility, export conventions, external packages, frameworks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _in(names: str) -> str:
    return f"(^|/)({'|'.join(names.split())})/"


def _ends(names: str) -> str:
    return f"({'|'.join(sorted(names.split()))})$"


_VERBS = "all controller delete get getmapping httpget httppost patch post postmapping put requestmapping route api_route"
#: (role, what it looks at, pattern): the first that matches names the role.
ROLES: list[tuple[str, str, str]] = [
    ("migration", "path", _in("alembic flyway migrations?")),
    ("migration", "name", "^(down|up)$"),
    ("controller", "signature", rf"(?i)@({'|'.join(_VERBS.split())}|app\.(delete|get|patch|post|put))\b"),
    ("controller", "path", _in("api controllers? endpoints? handlers? routes? views?")),
    ("controller", "name", _ends("Controller Endpoint Resource Route Router")),
    ("middleware", "path", _in("filters? guards? interceptors? middlewares?")),
    ("middleware", "name", _ends("Filter Guard Interceptor Middleware")),
    ("repository", "path", _in("daos? persistence repositories repository stores?")),
    ("repository", "name", _ends("Dao Mapper Repo Repository Store")),
    ("service", "path", _in("application domain services? usecases? use_cases?")),
    ("service", "name", _ends("Facade Interactor Manager Provider Service UseCase")),
    ("model", "path", _in("domain/model entities models? schemas?")),
    ("model", "name", _ends("Dto Entity Model Record Schema")),
    ("worker", "path", _in("consumers? listeners? subscribers? workers?")),
    ("worker", "name", _ends("Consumer Listener Processor Subscriber Worker")),
    ("worker", "signature", r"@(EventPattern|MessagePattern|Processor|shared_task|task)\b"),
    ("job", "path", _in("cron jobs? schedulers? tasks?")),
    ("job", "name", _ends("Cron Job Scheduler Task")),
    ("job", "signature", r"@(Cron|Interval|scheduled_job|Scheduled)\b"),
    ("handler", "name", "^(handle|on)[A-Z]"),
    ("handler", "name", "Handler$"),
    ("config", "path", r"(^|/)(config|configuration|settings)(/|\.)"),
    ("config", "name", _ends("Config Options Settings")),
    ("entrypoint", "path", r"(^|/)(app|cmd/[^/]+/main|index|main|server)\.[a-z]+$"),
    ("entrypoint", "name", "^(bootstrap|main|serve|start)$"),
]


def infer_role(path: Column, name: Column, signature: Column, is_test: Column) -> Column:
    """The role of a symbol: ``test`` in test files, else by the first rule that fits, else ``unknown``."""
    on = {"path": path, "name": name, "signature": F.coalesce(signature, F.lit(""))}
    out = F.when(is_test, F.lit("test"))
    for role, what, pattern in ROLES:
        out = out.when(on[what].rlike(pattern), F.lit(role))
    return out.otherwise(F.lit("unknown"))


def normalize_visibility(raw: Column, language: Column, name: Column) -> Column:
    """Go is package-private unless the name is capital."""
    return F.when((raw == "public") & (language == "go") & ~name.rlike("^[A-Z]"), F.lit("internal")).otherwise(raw)


def visibility_of(signature: Column, name: Column) -> Column:
    """By keywords in the first 80 characters; ``_`` and ``#`` names are private."""
    head = F.left(signature, F.lit(80))
    out = F.when(name.rlike("^[_#]"), F.lit("private"))
    for word in ("private", "protected", "internal"):
        out = out.when(head.rlike(rf"\b{word}\b"), F.lit(word))
    return out.otherwise(F.lit("public"))


def exported_by_convention(language: Column, name: Column) -> Column:
    return F.when(language == "go", name.rlike("^[A-Z]")).when(language == "python", ~name.startswith("_")).otherwise(F.lit(False))


def is_deprecated(doc: Column) -> Column:
    return F.coalesce(doc.rlike(r"(?i)@deprecated\b"), F.lit(False))


def external_package(language: Column, specifier: Column) -> Column:
    """The package that a specifier names outside the repository, or null."""
    none = F.lit(None).cast("string")
    parts = F.split(specifier, "/")
    npm = F.when(specifier.rlike(r"^([./]|node:)"), none).when(specifier.startswith("@") & (F.size(parts) >= 2), F.concat_ws("/", parts[0], F.try_element_at(parts, F.lit(2)))).otherwise(parts[0])
    head = F.substring_index(specifier, "::", 1)
    return (
        F.when(language.isin("typescript", "tsx", "javascript", "jsx"), npm)
        .when(language == "python", F.when(specifier.startswith("."), none).otherwise(F.substring_index(specifier, ".", 1)))
        .when(language == "go", F.when(F.contains(specifier, F.lit(".")), specifier))
        .when(language.isin("java", "kotlin", "csharp"), F.substring_index(specifier, ".", 2))
        .when(language == "rust", F.when(~head.isin("crate", "self", "super"), head))
    )


#: id: (label, category, packages, path patterns)
FRAMEWORKS: dict[str, tuple[str, str, list[str], list[str]]] = {}


def _add(category: str, *rows: str) -> None:
    """``id|label|packages|paths``, packages apart by spaces; a package may be left out where it is the id."""
    for row in rows:
        i, label, packages, *paths = row.split("|")
        FRAMEWORKS[i] = (label, category, packages.split() or [i], paths)


_add("web", "express|Express|", "fastify|Fastify|", "nestjs|NestJS|@nestjs/core @nestjs/common", "koa|Koa|", "hono|Hono|")
_add("frontend", r"nextjs|Next.js|next|^next\.config\.", "react|React|", "vue|Vue|", "svelte|Svelte|")
_add("web", r"django|Django|django Django|(^|/)manage\.py$|(^|/)settings\.py$".replace("(^|/)", "(^;/)"), "fastapi|FastAPI|", "flask|Flask|flask Flask", "gin|Gin|github.com/gin-gonic/gin", "echo|Echo|github.com/labstack/echo")
_add("web", "spring|Spring|org.springframework spring-boot-starter", "aspnet|ASP.NET|Microsoft.AspNetCore", "axum|Axum|", "actix|Actix|actix-web")
_add("orm", r"prisma|Prisma|@prisma/client prisma|schema\.prisma$", "typeorm|TypeORM|", "sequelize|Sequelize|", "drizzle|Drizzle|drizzle-orm", "sqlalchemy|SQLAlchemy|sqlalchemy SQLAlchemy")
_add("orm", "gorm|GORM|gorm.io/gorm", "hibernate|Hibernate|org.hibernate")
_add("queue", "bullmq|BullMQ|bullmq bull", "celery|Celery|", "kafka|Kafka|kafkajs confluent-kafka github.com/segmentio/kafka-go", "rabbitmq|RabbitMQ|amqplib pika")
_add("queue", "sqs|AWS SQS|@aws-sdk/client-sqs", "redis|Redis|redis ioredis github.com/redis/go-redis")
_add("test", "jest|Jest|", "vitest|Vitest|", "pytest|pytest|", "junit|JUnit|junit org.junit")
_add("build", r"docker|Docker|-|(^;/)Dockerfile|docker-compose\.ya?ml$")
_add("cloud", "kubernetes|Kubernetes|-|(^;/)k8s/|(^;/)helm/|(^;/)charts/", r"terraform|Terraform|-|\.tf$")
_add("build", r"githubactions|GitHub Actions|-|^\.github/workflows/")
FRAMEWORKS = {i: (label, cat, [p for p in packages if p != "-"], [p.replace("(^;/)", "(^|/)") for p in paths]) for i, (label, cat, packages, paths) in FRAMEWORKS.items()}

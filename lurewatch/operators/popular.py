"""Names of widely used packages, which look-alike names imitate; a landed table of the same shape can take their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Popular names by ecosystem.
NPM = (
    "lodash", "express", "react", "next", "axios", "chalk", "debug", "async", "request", "commander", "react-dom", "@types/node", "uuid", "fs-extra", "moment", "prop-types", "gulp", "webpack", "typescript", "eslint", "jest", "vue",
    "core-js", "redux", "mongoose", "passport", "socket.io", "body-parser", "express-async-handler", "dotenv", "cors", "bcrypt", "jsonwebtoken", "mysql", "pg", "redis", "winston", "morgan", "helmet", "joi", "zod", "yup",
    "class-validator", "ioredis", "node-fetch", "ramda", "underscore", "moment-timezone", "validator", "nconf", "path", "crypto", "stream", "events", "http", "https", "url", "querystring", "string_decoder", "streamroller",
    "archiver", "extract-zip", "mkdirp", "rimraf", "glob", "minimatch", "nopt", "semver", "tar", "https-proxy-agent", "agent-base", "ansi-regex", "ansi-styles", "supports-color", "ms", "eslint-plugin-import",
    "eslint-plugin-react", "babel-core", "@babel/core", "@babel/preset-env", "@babel/preset-react", "@babel/cli", "@babel/node", "webpack-cli", "webpack-dev-server", "html-webpack-plugin", "css-loader", "style-loader",
    "file-loader", "url-loader", "terser-webpack-plugin", "css-minimizer-webpack-plugin",
)
PYPI = (
    "requests", "urllib3", "setuptools", "six", "certifi", "idna", "python-dateutil", "boto3", "botocore", "s3transfer", "pyjwt", "numpy", "pandas", "flask", "django", "sqlalchemy", "pillow", "matplotlib", "pytest", "scipy",
    "scikit-learn", "ipython", "jinja2", "werkzeug", "markupsafe", "click", "itsdangerous", "blinker", "flask-cors", "flask-sqlalchemy", "psycopg2", "pyyaml", "cryptography", "paramiko", "fabric", "invoke", "tox", "twine",
    "pip", "pip-tools", "pip-compile", "poetry", "virtualenv", "celery", "redis-py", "kafka-python", "pymongo", "pymysql", "alembic", "python-dotenv", "pytz", "tzdata", "cffi", "pycparser", "pyasn1", "rsa", "cachetools",
    "google-auth", "ecdsa", "asn1crypto", "image", "opencv-python", "networkx", "sympy", "statsmodels", "seaborn", "plotly", "dash", "fastapi", "uvicorn", "starlette", "pydantic", "email-validator", "httpx", "aiohttp",
    "requests-toolbelt", "beautifulsoup4", "lxml", "html5lib", "cssselect", "selenium", "playwright", "scrapy", "pyquery", "tqdm", "colorama", "rich", "typer", "inquirer", "questionary", "prompt-toolkit", "pygments",
    "highlight.js", "markdown", "mistune", "commonmark", "recommonmark", "docutils", "sphinx", "sphinx-rtd-theme", "myst-parser",
)
CRATES = (
    "serde", "tokio", "log", "rand", "clap", "chrono", "regex", "lazy_static", "anyhow", "thiserror", "reqwest", "hyper", "actix-web", "axum", "tracing", "dashmap", "crossbeam", "rayon", "serde_json", "serde_yaml", "serde_xml",
    "toml", "ron", "rucp", "bimap", "once_cell", "parking_lot", "smallvec", "growable_vec", "ahash", "hashbrown", "indexmap", "slotmap", "frobenius", "num_cpus", "memchr", "memoffset", "find_crate", "libloading",
    "raw-window-handle", "fontdue", "image", "png", "jpeg", "gif", "bmp", "tiff", "webp", "gifski", "imageproc", "imageinfo", "resvg", "qrcode", "barcode", "uuid", "rustyline", "console", "argh", "gumdrop", "pico_args",
    "structopt", "derive_more", "num_derive", "enum_dispatch", "strum", "strum_macros", "color-eyre", "eyre", "tracing-subscriber", "tracing-appender", "tracing-attributes", "tracing-futures", "tracing-serde",
    "tracing-macros", "metrics", "metrics-exporter", "opentelemetry", "opentelemetry-api", "opentelemetry-sdk", "opentelemetry-otlp", "prost", "tonic", "grpcio", "sqlx", "diesel", "rustorm", "sea-orm", "tokio-postgres",
    "tokio-sqlite", "rusqlite", "mongodb", "redis", "kafka", "lapin", "mqtt", "nats", "warp", "rocket", "poem", "salvo", "tower", "tower-http", "http", "http-body", "httparse", "mime", "mime-guess", "content-type", "cookie",
    "cookie-store", "form_urlencoded", "url", "urlencoding", "percent-encoding",
)

#: Packages of lockfiles name the third ecosystem crates.io, for which no list is asked; the lists together know it all the same.
BY_ECOSYSTEM = {"npm": NPM, "PyPI": PYPI, "crates": CRATES}


def popular_names(spark: SparkSession) -> DataFrame:
    """(name, ecosystem) of the popular packages."""
    return spark.createDataFrame([(n, e) for e, names in BY_ECOSYSTEM.items() for n in names], "name string, ecosystem string")

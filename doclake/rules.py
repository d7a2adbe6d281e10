"""Rule tables as data. Users may extend the DataFrames they become."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# File kinds in rule order with the extensions that name them.
KIND_EXTENSIONS = [
    ("Pdf", ["pdf"]),
    ("Gif", ["gif"]),
    ("Image", ["png", "jpg", "jpeg", "webp", "tiff", "tif", "bmp", "ico", "avif", "exr", "qoi", "hdr", "dds",
               "farbfeld", "pnm", "pbm", "pgm", "ppm", "pam", "tga", "pcx"]),
    ("Video", ["mp4", "webm", "mkv", "mov", "avi", "wmv", "flv", "mpeg", "ogg", "m4v"]),
    ("Exe", ["exe"]),
    ("JpegXL", ["jxl"]),
    ("Svg", ["svg"]),
    ("Mermaid", ["mermaid"]),
    ("Html", ["html", "htm"]),
    ("Markdown", ["md", "markdown", "mdown", "mkd", "mkdn", "mdwn", "mdx", "mdc", "qmd", "rmd", "mmd"]),
    ("Tex", ["tex"]),
    ("Typst", ["typ"]),
    ("Lnk", ["lnk"]),
    ("Url", ["url"]),
]

# Converter formats in rule order with the extensions that select them.
FORMAT_EXTENSIONS = [
    ("package", ["apk", "ipa", "jar", "aar", "war", "ear", "deb", "rpm", "xpi", "crx", "nupkg", "whl", "egg"]),
    ("docx", ["docx", "docm", "dotx", "dotm"]),
    ("pptx", ["pptx", "pptm", "potx", "potm", "ppsx", "ppsm"]),
    ("odt", ["odt", "ott", "odm", "oth"]),
    ("odp", ["odp", "otp"]),
    ("ods", ["ods", "ots"]),
    ("xlsx", ["xlsx"]),
    ("xls", ["xls"]),
    ("zip", ["zip"]),
    ("tar", ["tar", "tgz", "txz"]),
    ("csv", ["csv", "tsv"]),
    ("sheet", ["xlsm", "xlsb", "xla", "xlam", "xltx", "xltm"]),
    ("html", ["html", "htm"]),
    ("markdown", ["md", "markdown", "mdown", "mkd", "mkdn", "mdwn", "mdx", "mdc", "qmd", "rmd", "mmd"]),
]

# MIME type to kind.
MIME_KINDS = [
    ("image/gif", "Gif"),
    ("image/svg+xml", "Svg"),
    ("image/png", "Image"),
    ("image/jpeg", "Image"),
    ("image/webp", "Image"),
    ("image/tiff", "Image"),
    ("image/bmp", "Image"),
    ("image/x-icon", "Image"),
    ("image/vnd.microsoft.icon", "Image"),
    ("image/avif", "Image"),
    ("image/vnd.radiance", "Image"),
    ("image/x-exr", "Image"),
    ("image/qoi", "Image"),
    ("image/x-portable-anymap", "Image"),
    ("image/farbfeld", "Image"),
    ("image/vnd.ms-dds", "Image"),
    ("video/mp4", "Video"),
    ("video/webm", "Video"),
    ("video/matroska", "Video"),
    ("video/quicktime", "Video"),
    ("video/avi", "Video"),
    ("video/x-msvideo", "Video"),
    ("video/x-ms-wmv", "Video"),
    ("video/x-flv", "Video"),
    ("video/mpeg", "Video"),
    ("video/ogg", "Video"),
    ("video/3gpp", "Video"),
    ("video/x-m4v", "Video"),
    ("application/pdf", "Pdf"),
    ("text/x-tex", "Tex"),
    ("text/html", "Html"),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "PreMarkdown"),
    ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "PreMarkdown"),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "PreMarkdown"),
    ("application/vnd.ms-excel", "PreMarkdown"),
    ("application/vnd.oasis.opendocument.text", "PreMarkdown"),
    ("application/vnd.oasis.opendocument.presentation", "PreMarkdown"),
    ("application/vnd.oasis.opendocument.spreadsheet", "PreMarkdown"),
    ("application/zip", "PreMarkdown"),
    ("application/x-tar", "PreMarkdown"),
    ("application/gzip", "PreMarkdown"),
    ("application/x-xz", "PreMarkdown"),
    ("application/json", "PreMarkdown"),
    ("application/x-yaml", "PreMarkdown"),
]


def rule_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A literal relation; its size is fixed by the code, so joins to it are always broadcast."""

    def literal(v) -> str:
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


# Extensions a listing shows as code.
CODE_EXTENSIONS = [
    "codes", "py", "rs", "js", "ts", "java", "c", "cpp", "h", "hpp", "go", "php", "rb", "sh", "pl", "lua", "swift",
    "kt", "kts", "scala", "dart", "elm", "hs", "ml", "mli", "r", "f", "f90", "cs", "vb", "asm", "s", "clj", "cljs",
    "edn", "coffee", "erl", "hrl", "ex", "exs", "json", "toml", "yaml", "yml", "xml", "html", "css", "scss", "less",
    "vue", "svelte", "md", "markdown", "tex", "nim", "zig", "v", "odin", "d", "sql", "ps1", "bash", "zsh", "fish",
]

# Extensions (and dot-file names) a listing shows as configuration.
CONFIG_EXTENSIONS = [
    "conf", "config", "ini", "cfg", "cnf", "properties", "env", "gitconfig", "gitignore", "npmrc", "yarnrc",
    "editorconfig", "dockerignore", "dockerfile", "makefile", "mk", "nginx", "apache", "htaccess", "htpasswd", "hosts",
    "service", "socket", "timer", "mount", "automount", "swap", "target", "path", "slice", "sysctl", "tmpfiles", "udev",
    "logind", "resolved", "timesyncd", "coredump", "journald", "netdev", "network", "link", "netctl", "wpa", "pacman",
    "mirrorlist", "vconsole", "locale", "fstab", "crypttab", "grub", "syslinux", "archlinux", "inputrc", "bashrc",
    "bash_profile", "bash_logout", "profile", "zshenv", "zshrc", "zprofile", "zlogin", "zlogout", "fishrc",
    "fish_variables", "fish_config", "fish_plugins", "fish_functions", "fish_completions", "fish_aliases",
    "fish_abbreviations", "fish_user_init", "fish_user_paths", "fish_user_variables", "fish_user_functions",
    "fish_user_completions", "fish_user_abbreviations", "fish_user_aliases", "fish_user_key_bindings",
]

# Extensions a listing shows as archives.
ARCHIVE_EXTENSIONS = [
    "zip", "tar", "gz", "bz2", "xz", "zst", "lz", "lzma", "lzo", "rz", "sz", "7z", "rar", "iso", "dmg", "pkg", "deb",
    "rpm", "crx", "cab", "msi", "ar", "cpio", "shar", "lbr", "mar", "sbx", "arc", "wim", "swm", "esd", "zipx", "zoo",
    "pak", "kgb", "ace", "alz", "apk", "arj", "ba", "bh", "cfs", "cramfs", "dar", "dd", "dgc", "ear", "gca", "ha",
    "hki", "ice", "jar", "lzh", "lha", "lzx", "partimg", "paq6", "paq7", "paq8", "pea", "pim", "pit", "qda", "rk",
    "sda", "sea", "sen", "sfx", "shk", "sit", "sitx", "sqx", "tar.Z", "uc", "uc0", "uc2", "ucn", "ur2", "ue2", "uca",
    "uha", "war", "xar", "xp3", "yz1", "zap", "zz",
]

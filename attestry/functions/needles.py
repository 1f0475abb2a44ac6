"""Substrings that make a source line a candidate for a check.

Each is matched anywhere in a line. ``candidate_lines`` takes any
table of this shape, so a project can pass its own.
"""

CATALOGUE = {
    "injection_sink": [
        ".execute(", ".executemany(", ".raw(", ".query(", ".exec(", ".aggregate(", ".find(", ".findOne(",
        ".find_one(", ".where(", ".whereRaw(", ".orderByRaw(", "$where", "subprocess.", "os.system(", "os.popen(",
        "child_process", "execSync(", "spawn(", "spawnSync(", "system(", "ldap", "cursor.execute",
    ],
    "unsafe_code_execution": [
        "eval(", "exec(", "new Function(", "pickle.load", "yaml.load(", "yaml.unsafe_load", "unserialize(",
        "marshal.load", "vm.run", "Function(", "deserialize(", "render_template_string(", "Template(",
        "jinja2.Template",
    ],
    "unescaped_output": [
        "innerHTML", "outerHTML", "dangerouslySetInnerHTML", "document.write(", "| safe", "|safe", "Markup(",
        "mark_safe(", "autoescape=False", "autoescape: false", "res.send(`", "res.send('", 'res.send("',
        "res.write(", ".html(", "insertAdjacentHTML", "v-html", "{{{",
    ],
    "path_from_input": [
        "send_file(", "sendFile(", "send_from_directory(", "open(", "readFile", "writeFile", "createReadStream",
        "createWriteStream", "os.path.join(", "path.join(", ".save(", "unlink(", "os.remove(", "rmdir", "mkdir",
        "res.download(", "fs.",
    ],
    "destination_from_input": [
        "redirect(", "res.location(", "requests.get(", "requests.post(", "requests.put(", "requests.request(",
        "urllib.request", "urlopen(", "fetch(", "axios.", "http.get(", "https.get(", "got(", "window.location",
        "location.href",
    ],
    "sensitive_data_exposure": [
        "console.log(", "console.error(", "console.info(", "console.debug(", "logger.info(", "logger.debug(",
        "logger.warn(", "logger.error(", "log.info(", "log.debug(", "log.warning(", "log.error(", "logging.info(",
        "logging.debug(", "logging.warning(", "logging.error(", "print(", "traceback", ".stack", "debug=True",
        "DEBUG = True", "DEBUG=True", "jsonify(", "res.json(", "res.send(",
    ],
    "weak_cryptography": [
        "md5", "sha1", "MD5", "SHA1", "Math.random(", "random.random(", "random.randint(", "random.choice(", "DES",
        "RC4", "ECB", "createCipher(", "iv = '", 'iv = "', "iv = b", "nonce = '", 'nonce = "',
    ],
    "weak_authentication": [
        "jwt.decode(", "verify: false", "verify:false", "algorithms=['none'", "algorithm: 'none'", ".password ==",
        "== password", "password ===", "password ==", "cookie(", "set_cookie(", "session[", "res.cookie(",
        "httpOnly: false", "secure: false", "expiresIn", "maxAge", "SESSION_COOKIE",
    ],
    "unchecked_mass_assignment": [
        "...req.body", "Object.assign(", ".update(req.body", ".create(req.body", "**request.json", "**request.form",
        "**request.args", "**data", "_.merge(", "lodash.merge", "deepmerge(", ".extend(", "__proto__", ".save()",
    ],
    "insecure_configuration": [
        "rejectUnauthorized: false", "rejectUnauthorized:false", "verify=False", "CSRF", "csrf", "cors(", "CORS(",
        "Access-Control-Allow-Origin", "origin: '*'", 'origin: "*"', "origin: true", "resolve_entities", "XMLParser",
        "etree.", "helmet", "X-Frame", "Content-Security-Policy", "SECURE_SSL", "ALLOWED_HOSTS",
    ],
    "missing_authorization": [
        "@app.route(", "@router.", "@bp.route(", "@blueprint.route(", "@api.", "app.get(", "app.post(", "app.put(",
        "app.patch(", "app.delete(", "app.all(", "app.use(", "router.get(", "router.post(", "router.put(",
        "router.patch(", "router.delete(", "server.get(", "server.post(", "fastify.get(", "fastify.post(", "@Get(",
        "@Post(", "@Put(", "@Patch(", "@Delete(", "export async function GET", "export async function POST",
        "export async function PUT", "export async function PATCH", "export async function DELETE",
        "export function GET", "export function POST", "def get(self", "def post(self", "def put(self",
        "def patch(self", "def delete(self", "path('", 'path("',
    ],
}

# Words in a name that say it holds a credential.
SECRET_NAMES = ["secret", "password", "passwd", "api_key", "apikey", "token", "private_key", "privatekey", "client_secret", "auth"]
# Prefixes of well-known access keys.
KEY_PREFIXES = ["sk_", "sk-", "pk_", "rk_", "AKIA", "ghp_", "xoxa-", "xoxb-", "xoxp-", "eyJ"]
# Files read for templates and for configuration.
TEMPLATE_EXTENSIONS = ["html", "htm", "ejs", "jinja2", "jinja", "hbs", "pug", "vue", "erb"]
CONFIG_EXTENSIONS = ["yml", "yaml", "json", "toml", "ini", "cfg"]
# What makes a template line worth asking about.
TEMPLATE_MARKS = [
    "{{", "{%", "<%", "v-html", "innerHTML", "| safe", "|safe", "autoescape", "<script", "href=", "href =", "src=", "src =", "on",
]
# Parts of a JSON file's name, and directories, that say it configures something.
CONFIG_NAMES = ["appsettings", "config", "conf", "credentials", "firebase", "secret", "secrets", "serviceaccount", "settings", "env"]
CONFIG_DIRECTORIES = ["config", "configs", "conf", "settings", "secrets"]
# Directories third-party code is served from.
SERVED_DIRECTORIES = [
    "assets", "bower_components", "lib", "libs", "plugins", "public", "static", "third-party", "third_party", "vendor",
    "vendors", "www", "wwwroot",
]
# Libraries that are copied into applications.
LIBRARIES = [
    "ace", "angular", "axios", "backbone", "bootstrap", "chart", "ckeditor", "codemirror", "d3", "datatables",
    "excanvas", "flot", "fontawesome", "handlebars", "highlight", "html5shiv", "jqvmap", "jquery", "knockout",
    "lodash", "mapael", "modernizr", "moment", "morris", "mustache", "pdfmake", "popper", "prism", "raphael",
    "redoc", "require", "respond", "select2", "slick", "socket.io", "sparkline", "summernote", "sweetalert",
    "swagger-ui", "swiper", "tinymce", "toastr", "underscore", "vfs_fonts", "zepto",
]
# Marks of a licence banner.
BANNERS = ["/*!", "@license", "Licensed under the MIT", "Licensed under MIT", "Licensed under the Apache"]

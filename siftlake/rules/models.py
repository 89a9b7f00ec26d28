"""Unsafe model loading in source code, and the names a model artefact must not refer to."""

from siftlake.rules.model import Family, Rule, check

# Identifiers, severities and patterns.
LOAD_RULES = check((
    Rule("CG_MODEL_SRC_001", "high", "unsafe-load-call", r"\btorch\.load\s*\([^)]*\)", "torch.load call", ("torch.load",)),
    Rule("CG_MODEL_SRC_002", "high", "unsafe-load-call", r"\bpickle\.(?:load|loads)\s*\(", "pickle load call", ("pickle.load",)),
    Rule("CG_MODEL_SRC_003", "high", "unsafe-load-call", r"\bjoblib\.load\s*\(", "joblib.load call", ("joblib.load",)),
    Rule("CG_MODEL_SRC_004", "critical", "unsafe-load-call", r"\btrust_remote_code\s*=\s*True", "Remote code trusted", ("trust_remote_code",)),
    # The original look-behinds can never reject a match, so they are left out.
    Rule("CG_MODEL_SRC_005", "medium", "unsafe-load-call", r"\bload_model\s*\([^)]*\)", "load_model call", ("load_model",)),
    Rule("CG_MODEL_SRC_006", "high", "unsafe-load-call", r"\byaml\.load\s*\([^)]*\)", "yaml.load call", ("yaml.load",)),
))
MODEL_LOAD = Family("model_load", LOAD_RULES, finding_type="model", skip_empty=True)

# Callables that a model file has no business referring to.
DANGEROUS_GLOBALS = (
    "os.system", "os.popen", "os.execv", "os.execve", "os.execvp", "os.execvpe", "os.spawn",
    "os.spawnv", "os.spawnve", "os.spawnvp", "posix.system", "nt.system", "subprocess.run",
    "subprocess.Popen", "subprocess.call", "subprocess.check_call", "subprocess.check_output",
    "subprocess.getoutput", "subprocess.getstatusoutput", "builtins.eval", "builtins.exec",
    "builtins.compile", "__builtin__.eval", "__builtin__.exec", "builtins.__import__",
    "importlib.import_module", "runpy._run_code", "runpy.run_path", "runpy.run_module",
    "code.InteractiveInterpreter", "socket.socket", "socket.create_connection",
    "urllib.request.urlopen", "urllib.urlopen", "requests.get", "requests.post",
    "http.client.HTTPConnection", "ftplib.FTP", "webbrowser.open", "webbrowser.open_new",
    "webbrowser.open_new_tab", "shutil.copy", "shutil.move", "shutil.rmtree", "os.remove",
    "os.unlink", "os.rmdir", "os.chmod", "os.chown", "pickle.loads", "pickle.load",
    "pickletools", "ctypes.CDLL", "ctypes.cdll", "ctypes.windll", "cffi.FFI",
)
SUSPICIOUS_GLOBALS = (
    "pty.spawn", "platform.popen", "commands.getoutput", "tempfile.mktemp", "zipfile.ZipFile", "tarfile.open",
)
# Module families that are normal in a model, and words that are not.
USUAL_MODULES = r"^(torch|numpy|collections|__builtin__|builtins|copy_reg|copyreg|_codecs|pickle|array)\b"
UNUSUAL_WORDS = r"(?i)(?:eval|exec|system|popen|spawn|shell|socket|request|urllib|subprocess|ctypes|cffi|runpy)"

# Artefact formats by extension and file name.
PICKLE_EXTENSIONS = (".pkl", ".pickle", ".pt", ".pth", ".bin", ".ckpt", ".joblib", ".dat", ".model")
KERAS_EXTENSIONS = (".h5", ".hdf5", ".keras")
ONNX_EXTENSIONS = (".onnx",)
SAFETENSORS_EXTENSIONS = (".safetensors",)
CONFIG_NAMES = ("config.json", "tokenizer_config.json", "generation_config.json", "configuration.json")

# Patterns over the artefact's bytes read as Latin-1.
GLOBAL_OPCODE = r"c([\w.]{1,127})\n([\w.]{1,127})\n"
LAMBDA_LAYER = r'(?i)"class_name"\s*:\s*"Lambda"'
EXTERNAL_DATA = r"""(?i)external_data[^\x00]{0,200}(?:https?://[^\s"'<>\x00]{5,200}|\.\./|file://)"""
OPERATOR_DOMAIN = r"""\bdomain\s*[:=]?\s*["']([^"'\x00]{3,80})["']"""
KNOWN_DOMAIN = r"^(ai\.onnx|com\.microsoft|org\.pytorch|ai\.onnx\.(ml|training|preview)|)$"
METADATA_HIDDEN = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]"
MAX_HEADER_BYTES = 100 * 1024 * 1024

"""Cryptocurrency-mining indicators."""

import re

from siftlake.rules.model import Family, Rule, check

# Mining pool host names.
POOL_HOSTS = (
    "xmr-eu1.nanopool.org", "xmr-eu2.nanopool.org", "xmr-us-east1.nanopool.org",
    "xmr-us-west1.nanopool.org", "xmr-asia1.nanopool.org", "pool.supportxmr.com",
    "mine.xmrpool.net", "pool.minexmr.com", "xmr.crypto-pool.fr", "xmr.pool.minergate.com",
    "monerohash.com", "xmrpool.eu", "randomxmonero.auto.nicehash.com", "unmineable.com",
    "stratum.antpool.com", "stratum.slushpool.com", "btc.viabtc.com", "eu.stratum.slushpool.com",
    "btc-global.f2pool.com", "us.litecoinpool.org", "etc-eu1.nanopool.org", "eth.2miners.com",
    "eu1.ethermine.org", "etc.ethermine.org", "auto.nicehash.com", "miningpoolhub.com",
    "prohashing.com", "f2pool.com",
)

# In-browser miner library names; a hyphen also stands for "_" or nothing.
MINER_LIBRARIES = (
    "coinhive.min.js", "coinhive.js", "coin-hive", "coin_hive", "cryptonight-asm.js",
    "cryptonight.js", "cryptonight-asmjs", "jsecoin", "cryptoloot", "crypto-loot", "deepminer",
    "jscoinminer", "webmine", "webminerpool", "minero.cc", "hashvault.pro", "webmine.cz",
    "coin-have", "coinimp",
)


def _any_of(names: tuple[str, ...], loose_hyphen: bool) -> str:
    parts = [re.escape(n).replace(r"\-", "[-_]?" if loose_hyphen else "-") for n in names]
    return r"(?i)\b(" + "|".join(parts) + r")\b"


# Identifiers, severities, categories and patterns.
RULES = check((
    Rule("CG_CJACK_POOL_HOST", "critical", "pool-url", _any_of(POOL_HOSTS, False), "Known mining pool host",
         ("nanopool", "supportxmr", "xmrpool", "minexmr", "crypto-pool", "minergate", "monerohash", "nicehash",
          "unmineable", "antpool", "slushpool", "viabtc", "f2pool", "litecoinpool", "2miners", "ethermine",
          "miningpoolhub", "prohashing")),
    Rule("CG_CJACK_MINER_LIB", "critical", "miner-lib", _any_of(MINER_LIBRARIES, True), "In-browser miner library",
         ("coin", "cryptonight", "crypto", "deepminer", "webmine", "minero.cc", "hashvault")),
    Rule("CG_CJACK_001", "critical", "pool-url", r"""(?i)\bstratum(?:\+(?:tcp|ssl|tls))?://[^\s"'<>]+""", "Stratum protocol URL", ("stratum",)),
    Rule("CG_CJACK_002", "high", "wallet-address", r"\b[48][0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b", "Monero wallet address", (), shape="[48][0-9ab][0-9a-z]{24}"),
    Rule("CG_CJACK_003", "medium", "wallet-address", r"\b(?:bc1[ac-hj-np-z02-9]{11,71}|[13][1-9A-HJ-NP-Za-km-z]{25,34})\b", "Bitcoin wallet address", (), shape="bc1[0-9a-z]{11}|[13][0-9a-z]{25}"),
    Rule("CG_CJACK_004", "low", "wallet-address", r"\b0x[a-fA-F0-9]{40}\b", "Ethereum wallet address", ("0x",)),
    Rule("CG_CJACK_005", "critical", "shell-miner", r"(?i)\bxmrig(?:\.exe)?(?:\s|$)", "xmrig invocation", ("xmrig",)),
    Rule("CG_CJACK_006", "critical", "shell-miner", r"(?i)\b(?:minerd|ccminer|cgminer|bfgminer|ethminer|phoenixminer|t-rex|nbminer|lolminer|gminer|teamredminer)(?:\.exe)?\b", "Known miner binary", ("miner", "t-rex")),
    Rule("CG_CJACK_007", "critical", "shell-miner", r"(?i)--(?:algo|coin)[ =](?:randomx|cryptonight|kawpow|etchash|ethash|autolykos2|kheavyhash|equihash)\b", "Miner algorithm flag", ("--algo", "--coin")),
    Rule("CG_CJACK_008", "critical", "miner-lib", r"\bCoinHive\.(?:Anonymous|User|Token|CaptchaToken)\b", "Coinhive API", ("coinhive.",)),
    Rule("CG_CJACK_009", "critical", "miner-lib", r"\bCryptonight(?:_?(?:v8|v7|asm|wasm|hash))?\b", "CryptoNight implementation", ("cryptonight",)),
    Rule("CG_CJACK_010", "high", "wasm-signature", r"(?i)\b(?:argon2i?d?|randomx|kawpow|equihash|ethash|autolykos)_?(?:hash|compute|init)\b", "Mining hash function", ("argon2", "randomx", "kawpow", "equihash", "ethash", "autolykos")),
    Rule("CG_CJACK_011", "critical", "encoded-payload", r"\bTVqQAAMAAAAEAAAA//8AALg[A-Za-z0-9+/=]{40,}", "Base64 Windows executable", ("tvqqaamaaaaeaaaa",)),
    Rule("CG_CJACK_012", "critical", "encoded-payload", r"\bf0VMR[A-Za-z0-9+/=]{40,}", "Base64 ELF executable", ("f0vmr",)),
))

CRYPTOJACK = Family("cryptojack", RULES, finding_type="cryptojacking", skip_empty=True)

# Package scripts that run without being asked for.
RISKY_SCRIPTS = ("preinstall", "install", "postinstall", "prepare", "prepublish", "prepublishOnly", "preuninstall", "postuninstall")

"""``python -m evalquarry VERB ...``"""

import sys

from evalquarry.verbs import main

main(sys.argv[1:])

"""Input for the scanner tests; never imported."""
import os
import pickle
import subprocess


def handle(command, archive):
    eval(command)
    exec(command)


    os.system(command)
    subprocess.call(command, shell=True)


    rows = pickle.load(archive)


    import hashlib
    digest = hashlib.md5(rows).hexdigest()
    return digest

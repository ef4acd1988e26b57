"""A client with the calls of S3's multipart uploads, over a folder that all processes share."""

import os
import shutil
import uuid


def reset(root):
    shutil.rmtree(os.path.join(root, "parts"), ignore_errors=True)


def log(root):
    with open(os.path.join(root, "log")) as f:
        return f.read().splitlines()


class Client:
    def __init__(self, root, fail_part=None):
        self.root, self.fail_part = root, fail_part

    def _say(self, line):
        with open(os.path.join(self.root, "log"), "a") as f:
            f.write(line + "\n")

    def create_multipart_upload(self, Bucket, Key, **more):
        self._say(f"create {Bucket} {Key}")
        name = uuid.uuid4().hex
        os.makedirs(os.path.join(self.root, "parts", name))
        return {"UploadId": name}

    def upload_part(self, Bucket, Key, UploadId, PartNumber, Body):
        if PartNumber == self.fail_part:
            raise OSError("no such luck")
        with open(os.path.join(self.root, "parts", UploadId, str(PartNumber)), "wb") as f:
            f.write(Body)
        return {"ETag": f"e{PartNumber}"}

    def complete_multipart_upload(self, Bucket, Key, UploadId, MultipartUpload):
        target = os.path.join(self.root, "done", Bucket, Key)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as out:
            for part in MultipartUpload["Parts"]:
                with open(os.path.join(self.root, "parts", UploadId, str(part["PartNumber"])), "rb") as f:
                    out.write(f.read())
        return {"Key": Key}

    def abort_multipart_upload(self, Bucket, Key, UploadId):
        self._say(f"abort {UploadId}")
        shutil.rmtree(os.path.join(self.root, "parts", UploadId), ignore_errors=True)

    def generate_presigned_url(self, what, Params, ExpiresIn):
        return f"https://{Params['Bucket']}/{Params['Key']}?for={ExpiresIn}"


def client(**options):
    return Client(**options)
